"""Candle analytics and strategy search on Spark DataFrames."""
