"""notegraph: schema-driven note collections as Spark DataFrames."""

__version__ = "0.1.0"
