"""Composed query plans: search, verification, evaluation, agent rounds."""
