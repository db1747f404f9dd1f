"""Part of the lectern package: sources."""
