"""Lodestack: passage retrieval and retrieval evaluation as Spark plans."""
