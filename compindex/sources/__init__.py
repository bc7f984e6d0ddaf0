"""Readers, writers and the keyed caches."""
