"""streaming of rowframe."""
