"""Syntax trees to DataFrames."""
