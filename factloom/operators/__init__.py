"""Operators that compose DataFrame operations over fact tables."""
