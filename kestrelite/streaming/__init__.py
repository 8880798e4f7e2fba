"""Structured Streaming forms of the event views."""
