"""Column functions: hash order, scalar transforms."""
