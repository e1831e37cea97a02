"""Readers that turn laboratory files into DataFrames."""
