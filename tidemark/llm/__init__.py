"""Operators for text corpora and model training data; nothing else in the library imports this."""
