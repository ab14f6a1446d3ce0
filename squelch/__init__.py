"""Spark-native analytics over speech archives and the transcripts of many models.

Every operator is a plain function from DataFrames to a DataFrame, so that it
composes with ``DataFrame.transform`` and is planned by Catalyst.
"""
