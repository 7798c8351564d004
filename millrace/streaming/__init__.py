"""Structured Streaming: stateful filters, idempotent apply."""
