"""folioforge: retrieval corpora from page texts, on Spark.

Text functions are column expressions, stages are functions from DataFrames to DataFrames.
"""
