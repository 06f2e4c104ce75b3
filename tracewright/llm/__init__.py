"""Operators of a training-data pipeline, each over a `documents`-like DataFrame.

Nothing else in the package imports this subpackage.
"""
