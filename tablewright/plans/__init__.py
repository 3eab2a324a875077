"""Workflows composed of several operators."""
