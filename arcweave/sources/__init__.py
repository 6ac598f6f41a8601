"""Arcweave sources."""
