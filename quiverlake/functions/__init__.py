"""Functions of quiverlake."""
