"""operators of the library engine."""
