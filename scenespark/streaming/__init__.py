"""Structured Streaming: scenes as they arrive."""
