"""Align of the engine."""
