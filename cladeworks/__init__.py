"""cladeworks: evolutionary sequence analytics and sequence-corpus processing on Spark DataFrames."""

__version__ = "0.1.0"
