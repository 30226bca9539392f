"""Column expressions and the Arrow-batch kernels used inside tasks."""
