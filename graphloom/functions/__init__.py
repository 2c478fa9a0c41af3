"""Column expressions: text, paths, costs."""
