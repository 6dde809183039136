"""Raster, animation-metadata and usage analytics as Spark plans."""
