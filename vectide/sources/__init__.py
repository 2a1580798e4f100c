"""Vectide: sources."""
