"""Column functions over SQL text and names."""
