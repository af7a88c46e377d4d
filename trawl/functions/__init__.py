"""Column functions: text, similarity."""
