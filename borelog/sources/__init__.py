"""Borelog sources."""
