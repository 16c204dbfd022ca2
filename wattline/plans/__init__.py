"""wattline.plans."""
