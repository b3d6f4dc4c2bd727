"""Table operators for crawled-site corpora and content trees, on Spark DataFrames."""

__version__ = "0.1.0"
