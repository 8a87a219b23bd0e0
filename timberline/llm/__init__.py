"""Operators for training data: distinctive terms, frequent subsequences, runs, token ids, mixing, subjects."""
