"""Tier-aware graph and text analytics on Spark DataFrames."""
