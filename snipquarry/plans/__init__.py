"""Helpers that shape the physical plan: skew, numbering, scratch tables."""
