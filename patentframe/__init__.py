"""Patent data and training corpora on Spark."""

__version__ = "0.1.0"
