"""pitlane: lap analytics and model scoring on Spark DataFrames."""

__version__ = "0.1.0"
