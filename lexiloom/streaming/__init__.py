"""Structured Streaming entry points for files that keep arriving."""
