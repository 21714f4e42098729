"""Corpuscle: analytics over code corpora and translation experiments, on Spark DataFrames."""
