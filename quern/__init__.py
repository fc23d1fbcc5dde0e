"""Keyed feature tables and batch lookups on Spark DataFrames."""
