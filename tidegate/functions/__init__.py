"""Column expressions and small aggregate helpers."""
