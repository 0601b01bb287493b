"""Column expressions for text, vectors and paths."""
