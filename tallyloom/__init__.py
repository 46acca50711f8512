"""Tallyloom: cohort assembly, dataset checks, safe release and large-scale data preparation on Spark DataFrames."""
