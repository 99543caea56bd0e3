"""Spark-first analytics over entity panels and nested ownership hierarchies."""

__version__ = "0.1.0"
