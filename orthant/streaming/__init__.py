"""Additive statistics of streams."""
