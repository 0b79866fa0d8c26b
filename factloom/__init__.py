"""A PySpark engine for policy queries over normalised fact tables."""
