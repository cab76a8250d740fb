"""Scans and sinks: vocabulary text, cluster JSON, model tables."""
