"""Incremental versions over streams."""
