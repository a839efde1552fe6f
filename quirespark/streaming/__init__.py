"""streaming of the library engine."""
