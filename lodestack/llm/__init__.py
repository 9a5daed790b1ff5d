"""Operators for building training data: names, vectors, scans, pairs, tokens, mixing, toxicity."""
