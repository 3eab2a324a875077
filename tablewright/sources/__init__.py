"""Readers and writers: CSV, run tables, reports, models."""
