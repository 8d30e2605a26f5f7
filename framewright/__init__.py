"""Framed signals, labels and models over Spark DataFrames."""
