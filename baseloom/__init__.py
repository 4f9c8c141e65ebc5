"""Genome-composition analytics on Spark DataFrames."""
