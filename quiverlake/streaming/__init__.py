"""Streaming of quiverlake."""
