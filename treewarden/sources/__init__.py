"""Where files come from, and where findings go."""
