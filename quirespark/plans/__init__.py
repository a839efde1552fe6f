"""plans of the library engine."""
