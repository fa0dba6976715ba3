"""Streaming of lensmill."""
