"""Readers and writers of corpora, vectors and request files."""
