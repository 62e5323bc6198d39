"""operators of the line analytics library."""
