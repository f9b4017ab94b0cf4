"""Operators for preparing training corpora with Spark."""
