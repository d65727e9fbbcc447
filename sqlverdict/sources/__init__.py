"""Where queries run and where cases and tables come from."""
