"""Readers, writers and views over the sample tables."""
