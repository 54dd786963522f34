"""Detections to identity tracks to metrics, on Spark DataFrames."""
