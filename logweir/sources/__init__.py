"""Where lines come from and where they are kept."""
