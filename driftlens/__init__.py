"""Driftlens: differential analytics over trees of text artifacts, as Spark jobs."""

__version__ = "0.2.0"
