"""Vectide: streaming."""
