"""Corpus analytics on Spark: typed sources, text functions, search, merges, reports and streams."""
