"""Sources of siftwell."""
