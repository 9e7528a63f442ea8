"""Selections, plans and summaries of tracks and samples, as functions from DataFrames to DataFrames."""
