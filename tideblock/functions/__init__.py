"""Part of tideblock."""
