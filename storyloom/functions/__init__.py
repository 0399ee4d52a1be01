"""functions of the story engine."""
