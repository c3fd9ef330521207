"""repset: choose the best representative of every group of near-identical items, on Spark."""

__version__ = "0.1.0"
