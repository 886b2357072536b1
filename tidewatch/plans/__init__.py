"""Whole jobs: scoring, tuning and reports."""
