"""Deltas of versions that arrive as a stream."""
