"""Micro-batch forms of the ingest run and the publish worker."""
