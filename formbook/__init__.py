"""Leak-free form features and two-sided market analytics on Spark DataFrames."""
