"""Structured Streaming entry points: the tracks of a running capture and event-time windows."""
