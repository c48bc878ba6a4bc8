"""Operators on texts and vectors at training-corpus scale. Nothing else in the library imports this package."""
