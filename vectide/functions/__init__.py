"""Vectide: functions."""
