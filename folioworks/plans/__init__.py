"""Whole dataflows, and the queries over the driver tables."""
