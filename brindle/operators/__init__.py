"""Part of brindle: operators."""
