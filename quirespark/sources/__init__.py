"""sources of the library engine."""
