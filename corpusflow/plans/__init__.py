"""Whole plans built from the operators: hybrid retrieval, ingestion, answer context."""
