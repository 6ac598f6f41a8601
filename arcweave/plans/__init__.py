"""Arcweave plans."""
