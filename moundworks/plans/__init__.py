"""The score models: plain functions from input DataFrames to result DataFrames."""
