"""Rules that a classifier answers: candidates as JSON, batched classification, decision tables."""
