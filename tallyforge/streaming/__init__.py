"""Connections assembled from event streams."""
