"""Inputs as frames."""
