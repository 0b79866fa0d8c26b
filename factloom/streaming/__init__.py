"""Structured Streaming forms of the queries."""
