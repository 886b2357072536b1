"""Structured Streaming variant of the activity aggregation."""
