"""Borelog functions."""
