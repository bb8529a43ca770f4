"""Contribution statistics over collaborative map-editing history, on Spark."""

__version__ = "0.1.0"
