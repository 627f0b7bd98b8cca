"""Measurement operators: each takes voxel (or point) DataFrames and returns DataFrames."""
