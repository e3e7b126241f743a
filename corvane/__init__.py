"""Corvane: building and querying web-page corpora with Spark DataFrames."""
