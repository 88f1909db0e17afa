"""Chromatogram evidence analytics on Spark."""
