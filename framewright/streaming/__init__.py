"""Frames as streams: windows, sessions and incremental models."""
