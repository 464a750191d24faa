"""Readers, writers and projections of source tables."""
