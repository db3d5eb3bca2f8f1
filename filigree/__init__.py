"""Spatial graphs, rasters and their scores as Spark DataFrames."""
