"""Spatial-semantic analytics as ordinary Spark DataFrame work."""
