"""Stateful streaming detectors."""
