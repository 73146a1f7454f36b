"""Part of brindle: sources."""
