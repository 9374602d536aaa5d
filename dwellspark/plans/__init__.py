"""Whole flows built of the operators: search, ingest, evaluation."""
