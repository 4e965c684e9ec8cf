"""Structured Streaming: design snapshots that arrive over time."""
