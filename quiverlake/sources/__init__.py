"""Sources of quiverlake."""
