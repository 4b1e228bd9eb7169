"""Operators that prepare training data. Nothing else in the package imports this folder."""
