"""Windowed operators that run the same on streams and on batches."""
