"""operators of the story engine."""
