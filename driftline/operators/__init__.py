"""Change-point operators over series tables."""
