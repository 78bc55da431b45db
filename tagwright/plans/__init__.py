"""tagwright plans."""
