"""Operators of duovox."""
