"""Operators over sources, records, graphs and rasters."""
