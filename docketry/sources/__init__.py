"""sources of the case analytics engine."""
