"""wattline.operators."""
