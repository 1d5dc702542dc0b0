"""Column expressions and NumPy kernels."""
