"""Part of korrel."""
