"""Timed, checkable briefings from large document collections, on Spark."""
