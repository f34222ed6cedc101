"""Changes of a tree as a stream."""
