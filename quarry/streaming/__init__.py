"""Folders and event streams: ingest jobs, their status, and windowed counts."""
