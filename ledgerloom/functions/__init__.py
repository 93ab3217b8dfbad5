"""Column-level helpers: exact integer math, text and number formats."""
