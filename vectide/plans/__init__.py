"""Vectide: plans."""
