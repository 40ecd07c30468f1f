"""Scans, landing-file screening, row order and sinks."""
