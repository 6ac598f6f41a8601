"""Arcweave functions."""
