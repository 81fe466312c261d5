"""Declarative document transformation and corpus analytics on Spark DataFrames."""
