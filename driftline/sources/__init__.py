"""Scans and sinks: series tables, labels, scores, sharded matrices."""
