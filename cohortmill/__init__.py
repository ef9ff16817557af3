"""Cohort analytics on Spark DataFrames: every operator takes and returns DataFrames."""
