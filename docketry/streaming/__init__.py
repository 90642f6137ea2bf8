"""streaming of the case analytics engine."""
