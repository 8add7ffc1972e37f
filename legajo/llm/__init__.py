"""Operators for training data: pairs, leaks, survivors, repeated lines, near copies, splits, scans, tokens, mixes, cuts."""
