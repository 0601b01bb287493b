"""Relational retrieval operators."""
