"""Loomframe: learn, generate, protect and judge tables with Spark DataFrames."""
