"""Structured Streaming forms of batch operators (extensions)."""
