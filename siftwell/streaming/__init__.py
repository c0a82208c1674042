"""Streaming of siftwell."""
