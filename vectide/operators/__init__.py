"""Vectide: operators."""
