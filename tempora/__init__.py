"""Interval, timeline and transcript analytics on Spark DataFrames."""
