"""Statistics over findings and history."""
