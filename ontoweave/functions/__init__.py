"""Column functions: text and similarity."""
