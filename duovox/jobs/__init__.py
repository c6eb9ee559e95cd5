"""Jobs of duovox."""
