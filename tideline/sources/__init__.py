"""sources of the line analytics library."""
