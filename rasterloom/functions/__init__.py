"""Column expressions and Arrow-batched functions."""
