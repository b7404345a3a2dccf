"""Configured pipelines: from a configuration to candidates, metrics and a run record."""
