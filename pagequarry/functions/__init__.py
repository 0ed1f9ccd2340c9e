"""Column functions: text, finance, geometry."""
