"""wattline.functions."""
