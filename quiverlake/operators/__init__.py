"""Operators of quiverlake."""
