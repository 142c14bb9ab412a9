"""Expressions, aggregations and registered functions."""
