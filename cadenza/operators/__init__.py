"""Relational and recommender operators, each a function from DataFrames to DataFrames."""
