"""Compound-document formats in plain Python: total functions over bytes, without Spark."""
