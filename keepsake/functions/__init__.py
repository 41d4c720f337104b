"""Column expressions, by subject."""
