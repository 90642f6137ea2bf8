"""functions of the case analytics engine."""
