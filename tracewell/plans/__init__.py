"""Ingest, provenance interface, statistics, plug-ins and the query catalogue."""
