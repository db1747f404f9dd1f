"""Part of the lectern package: operators."""
