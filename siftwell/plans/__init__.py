"""Plans of siftwell."""
