"""Readers and model catalogs."""
