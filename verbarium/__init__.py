"""Verb-inflection extraction and analytics on Spark DataFrames."""
