"""Declarative data pipelines on Spark DataFrames."""
