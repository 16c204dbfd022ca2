"""wattline.sources."""
