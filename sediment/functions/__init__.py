"""Hashes, profiles, media types, probes."""
