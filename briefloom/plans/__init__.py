"""Compositions of operators exposed as one call."""
