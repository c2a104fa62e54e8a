"""Streams of frames."""
