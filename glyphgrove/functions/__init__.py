"""Column builders over vectors and node paths."""
