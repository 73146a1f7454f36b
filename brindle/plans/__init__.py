"""Part of brindle: plans."""
