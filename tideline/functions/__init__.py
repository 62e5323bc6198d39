"""functions of the line analytics library."""
