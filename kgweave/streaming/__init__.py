"""Structured Streaming forms of episode statistics."""
