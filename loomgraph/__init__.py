"""Spark-first analytics over source trees, linked records and text corpora."""

__version__ = "0.1.0"
