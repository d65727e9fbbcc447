"""Metric definitions compiled to DataFrames."""
