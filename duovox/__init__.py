"""Spark jobs for time series of paired measurements, and for text corpora."""
