"""Operators for training-data corpora. Nothing else in duovox imports this subpackage."""
