"""Functions of siftwell."""
