"""Column expressions: text, units, markup, geometry and measurement."""
