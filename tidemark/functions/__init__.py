"""Column functions: text, dimensions, time, numbers."""
