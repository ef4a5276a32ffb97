"""Readers and row mappers."""
