"""almudi: retail price analytics and catalogue data processing on Spark DataFrames."""

__version__ = "0.1.0"
