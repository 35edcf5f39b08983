"""Column expressions (text, cost)."""
