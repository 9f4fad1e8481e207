"""Lodestack: supply-chain inventory analytics as Spark DataFrames."""
