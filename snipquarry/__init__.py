"""Indexing and searching source code and text with Spark DataFrames."""

__version__ = "0.1.0"
