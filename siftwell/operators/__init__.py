"""Operators of siftwell."""
