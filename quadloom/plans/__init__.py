"""Mappings, their text form, and what is decided about them before anything runs."""
