"""plans of the case analytics engine."""
