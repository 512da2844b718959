"""Streaming twins of the operators whose state is bounded."""
