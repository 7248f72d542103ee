"""Relational, statistical and vector-set operators on DataFrames."""
