"""Workflow provenance analytics on Spark."""
