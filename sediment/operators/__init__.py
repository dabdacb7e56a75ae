"""Cutting, taking apart, rebuilding and measuring."""
