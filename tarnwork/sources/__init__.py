"""sources of the audit engine."""
