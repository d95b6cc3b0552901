"""Scholiast: analytics over corpora of scholarly documents as Spark DataFrames."""

__version__ = "0.1.0"
