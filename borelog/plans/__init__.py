"""Borelog plans."""
