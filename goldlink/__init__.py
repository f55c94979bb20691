"""goldlink: entity resolution and golden-record construction on Spark DataFrames."""

__version__ = "0.1.0"
