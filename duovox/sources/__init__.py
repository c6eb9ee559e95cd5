"""Sources of duovox."""
