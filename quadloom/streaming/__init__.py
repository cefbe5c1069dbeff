"""Change logs: folding them, and ingesting them as streams."""
