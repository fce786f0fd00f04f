"""veldra: data preparation, profiling, sampling and cluster analysis on Spark DataFrames."""

__version__ = "0.1.0"
