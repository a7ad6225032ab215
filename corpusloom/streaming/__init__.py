"""Streaming twins of dedupe, metrics and sequence state."""
