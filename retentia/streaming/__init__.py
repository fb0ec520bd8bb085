"""Structured Streaming scoring of incoming profile records."""
