"""Streams of acquisitions and measures."""
