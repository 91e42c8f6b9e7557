"""Column expressions: analysis, scoring and scalars."""
