"""Operators for building training corpora: one module per operator, all driven by Spark DataFrames."""
