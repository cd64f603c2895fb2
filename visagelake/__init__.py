"""Spark jobs for face metadata of large photo collections."""
