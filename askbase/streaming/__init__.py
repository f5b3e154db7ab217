"""Structured Streaming versions of answering and logging."""
