"""Readers with explicit schemas, writers, providers and the Python data source for sample plugins."""
