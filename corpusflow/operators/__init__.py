"""Operators on DataFrames: retrieval, evidence, chunking, catalogue, federation, citation."""
