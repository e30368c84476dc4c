"""Readers, writers and the stored tables."""
