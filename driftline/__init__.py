"""Streaming change-point analytics as DataFrame plans."""
