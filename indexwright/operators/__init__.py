"""DataFrame operators of the index core."""
