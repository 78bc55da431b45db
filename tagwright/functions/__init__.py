"""tagwright functions."""
