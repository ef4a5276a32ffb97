"""Incremental processing of review streams."""
