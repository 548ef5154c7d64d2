"""Spatial evidence analytics on Spark: DataFrame in, DataFrame out."""
