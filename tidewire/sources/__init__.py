"""Readers, writers and the shaping of raw records."""
