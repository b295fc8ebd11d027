"""Structured Streaming forms of the feedback operators."""
