"""Whole jobs: ingest, training, and one query per operator."""
