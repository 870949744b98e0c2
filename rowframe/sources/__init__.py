"""sources of rowframe."""
