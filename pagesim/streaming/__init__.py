"""Pages and events as streams."""
