"""Statements from streams."""
