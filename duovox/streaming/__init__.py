"""Streaming of duovox."""
