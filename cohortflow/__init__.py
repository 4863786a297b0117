"""Cohort analytics operators on Spark DataFrames."""
