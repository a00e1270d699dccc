"""Operators for training-data pipelines over tables of texts and vectors.

Nothing else in the library imports this subpackage.
"""
