"""Column expressions: tensors, hashing, text and fixed values."""
