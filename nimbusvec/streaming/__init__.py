"""Structured Streaming: inserting a stream of vectors, one index version for each micro-batch."""
