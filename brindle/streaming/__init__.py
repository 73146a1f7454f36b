"""Part of brindle: streaming."""
