"""Column expressions, argument checks and numerical kernels."""
