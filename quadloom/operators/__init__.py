"""Relational operators: from triples maps to statements."""
