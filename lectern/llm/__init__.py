"""Operators that prepare text collections for training.  Nothing outside this package imports it."""
