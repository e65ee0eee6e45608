"""Operators on library tables: plain functions from DataFrames to DataFrames."""
