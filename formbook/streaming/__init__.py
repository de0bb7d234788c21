"""Incremental ingest and evaluation."""
