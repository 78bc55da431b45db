"""tagwright operators."""
