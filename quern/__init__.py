"""quern: similarity analytics over embedding vectors, expressed as Spark DataFrames."""

__version__ = "0.1.0"
