"""Operators of lensmill."""
