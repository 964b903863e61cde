"""Glyphloom: glyph-recognition data operators as Spark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
