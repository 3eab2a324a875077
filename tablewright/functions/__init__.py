"""Column expressions and shared table functions used by the operators."""
