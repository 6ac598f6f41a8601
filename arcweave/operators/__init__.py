"""Arcweave operators."""
