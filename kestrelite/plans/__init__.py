"""Settings and gates of runs."""
