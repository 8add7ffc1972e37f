"""Column functions: text, arrays, hashing, dates."""
