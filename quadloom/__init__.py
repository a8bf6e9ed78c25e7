"""Declarative knowledge-graph materialization on Spark."""
