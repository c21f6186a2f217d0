"""Millrace: build, defend and compare data corpora with PySpark DataFrames."""
