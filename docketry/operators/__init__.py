"""operators of the case analytics engine."""
