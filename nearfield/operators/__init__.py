"""Operators over vector tables and key tables."""
