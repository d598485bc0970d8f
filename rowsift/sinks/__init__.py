"""Renderers of results."""
