"""Structured Streaming forms of the event cleaning."""
