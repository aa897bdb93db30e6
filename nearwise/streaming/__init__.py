"""Structured Streaming retrieval."""
