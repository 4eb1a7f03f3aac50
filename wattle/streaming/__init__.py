"""Streaming forms of the batch operators (Structured Streaming)."""
