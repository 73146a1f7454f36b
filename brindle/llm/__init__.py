"""Operators for preparing language-model training corpora. Nothing else in brindle imports this package."""
