"""Brindle: social-activity analytics and corpus preparation as lazy PySpark DataFrame operators."""
