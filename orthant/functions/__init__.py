"""Numerical parts: harmonic moments, the solver for their medians, and power-to-harmonic transforms."""
