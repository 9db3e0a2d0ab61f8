"""Chained price-index analytics over quote tables, written for Spark.

Every public function takes DataFrames and plain parameters and returns a
DataFrame. Nothing here triggers an action except the sinks.
"""
