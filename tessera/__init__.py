"""tessera: statistics over collections of vectors, series and pairwise matrices, on Spark."""

__version__ = "0.1.0"
