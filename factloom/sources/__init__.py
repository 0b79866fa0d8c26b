"""Ingest of fact tables and raw records."""
