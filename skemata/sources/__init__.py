"""Where catalogs come from and go to."""
