"""Column functions: JSON fields, tokens, timestamps."""
