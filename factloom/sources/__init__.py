"""Readers, writers and generators of facts."""
