"""Plans of quiverlake."""
