"""Column functions: text to number, and number to signal."""
