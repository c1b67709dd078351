"""Spark-native sparse-geophysics raster analytics on DataFrames."""
