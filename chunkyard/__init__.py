"""Voxel chunks as DataFrames: a Spark-native engine."""
