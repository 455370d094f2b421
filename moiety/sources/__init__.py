"""Where molecules come from and where indexes are kept."""
