"""Part of nestql."""
