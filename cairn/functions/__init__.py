"""Scalar functions on columns, and parsers for the values users type."""
