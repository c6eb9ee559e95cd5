"""Functions of duovox."""
