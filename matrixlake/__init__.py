"""matrixlake: sparse count-matrix corpora as Spark DataFrames."""

__version__ = "0.1.0"
