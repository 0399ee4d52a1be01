"""streaming of the story engine."""
