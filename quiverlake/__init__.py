"""quiverlake: similarity search and analytics over vector tables on Spark."""

__version__ = "0.1.0"
