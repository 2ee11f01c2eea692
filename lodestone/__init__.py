"""Lodestone: retrieval, knowledge-graph and corpus analytics expressed as Spark plans."""
