"""operators of rowframe."""
