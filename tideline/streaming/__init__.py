"""streaming of the line analytics library."""
