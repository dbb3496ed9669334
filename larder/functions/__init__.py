"""Column expressions of the catalogue."""
