"""Readers and views of tables."""
