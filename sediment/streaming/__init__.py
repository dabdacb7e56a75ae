"""Streams that arrive in windows."""
