"""Operators for preparing text and code as training data. Nothing else in the library imports this package."""
