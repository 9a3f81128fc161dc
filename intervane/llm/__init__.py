"""Operators for text and sequence training data. Nothing else in the library imports this."""
