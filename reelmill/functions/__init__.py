"""Column expressions: text and scoring."""
