"""tagwright streaming."""
