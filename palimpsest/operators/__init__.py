"""Operators over logs of mutations; plain DataFrames in and out."""
