"""Building, writing and keeping the index."""
