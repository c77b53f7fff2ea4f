"""Tarnsift: retrieval, property-graph and data-quality operators as lazy Spark plans."""
