"""Spark jobs that prepare, balance and evaluate aerial-image training data."""
