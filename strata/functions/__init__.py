"""Column functions: text, hashing, collections."""
