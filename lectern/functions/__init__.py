"""Scalar rules and storage that operators share."""
