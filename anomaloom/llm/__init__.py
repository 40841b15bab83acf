"""Operators for training-data corpora and their queries over the given tables."""
