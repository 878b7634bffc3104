"""Where pages and plans come from."""
