"""Operators for training data: grouping, similarity, text repair, leakage, mixing and subjects."""
