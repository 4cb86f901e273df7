"""Voxel-and-cohort analytics on Spark DataFrames."""
