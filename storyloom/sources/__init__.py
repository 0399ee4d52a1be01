"""sources of the story engine."""
