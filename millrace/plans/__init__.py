"""Shared plan shapes and the catalogue of queries."""
