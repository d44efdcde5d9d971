"""Relational, graph and retrieval operators."""
