"""Arcweave streaming."""
