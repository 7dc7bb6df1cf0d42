"""Scalar, aggregate, JSON and table-valued functions."""
