"""Stored collections."""
