"""Column functions: element types, complex numbers, index arithmetic."""
