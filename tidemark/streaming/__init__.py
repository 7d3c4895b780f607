"""Structured Streaming forms of the snapshots."""
