"""strandline: change-feed, triple-graph and question analytics on Spark DataFrames."""

__version__ = "0.1.0"
