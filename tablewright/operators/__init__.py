"""Analytical operators, one module per family."""
