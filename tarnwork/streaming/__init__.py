"""streaming of the audit engine."""
