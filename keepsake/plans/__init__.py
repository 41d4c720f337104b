"""Whole plans built of operators: retrieval, ingestion, and the registered queries."""
