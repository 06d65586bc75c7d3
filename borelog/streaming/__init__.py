"""Borelog streaming."""
