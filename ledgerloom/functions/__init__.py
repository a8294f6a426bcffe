"""Column expressions of one row."""
