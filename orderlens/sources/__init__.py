"""Readers and writers: CSV ingest, stand-in views, snapshots."""
