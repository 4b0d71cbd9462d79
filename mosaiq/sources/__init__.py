"""Where photographs come from and where mosaics go."""
