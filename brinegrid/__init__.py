"""Gridded geospatial analytics and batch voyage routing on Spark DataFrames."""
