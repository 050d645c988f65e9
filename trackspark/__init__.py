"""Trajectory and identity analytics on Spark DataFrames."""
