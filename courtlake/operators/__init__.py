"""Part of courtlake."""
