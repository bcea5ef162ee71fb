"""Sievelight: log, data-quality, evaluation and retrieval analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
