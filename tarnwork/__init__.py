"""Submission-audit analytics on Spark DataFrames: selection, deltas, near-duplicates, scopes, reviews."""
