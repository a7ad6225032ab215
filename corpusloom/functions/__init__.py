"""Column functions: text, arrays and vectors."""
