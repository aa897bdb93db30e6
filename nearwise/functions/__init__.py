"""Column expressions: text, tags and vectors."""
