"""Grading of scanned worksheet pages as Spark DataFrames."""
