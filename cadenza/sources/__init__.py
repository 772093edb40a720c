"""Readers, writers and the markup shredder."""
