"""Aggregation, feature, scoring and filter operators."""
