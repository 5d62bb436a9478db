"""Mensura: quantity take-off, costing and corpus processing on Spark DataFrames."""
