"""Retrieval, evidence-graph and corpus jobs over document tables, as DataFrame work."""
