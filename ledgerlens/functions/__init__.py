"""Column expressions and size checks."""
