"""plans of rowframe."""
