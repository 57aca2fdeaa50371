"""Column expressions: comparisons, sphere, cosmology and pixels."""
