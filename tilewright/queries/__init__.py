"""Registered queries over fixtures derived from the driver tables."""
