"""Scalar functions as column expressions: numbers, strings, dates and keys."""
