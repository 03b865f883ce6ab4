"""Spatial trees, interaction lists and lookups as Spark DataFrame jobs."""
