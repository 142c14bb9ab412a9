"""Transformers of results."""
