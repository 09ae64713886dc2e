"""Sparse similarity search on Spark."""
