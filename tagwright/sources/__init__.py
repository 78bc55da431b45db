"""tagwright sources."""
