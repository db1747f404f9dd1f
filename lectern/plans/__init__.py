"""Part of the lectern package: plans."""
