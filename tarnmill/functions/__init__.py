"""Column functions: text and digests, numbers and arrays."""
