"""Borelog operators."""
