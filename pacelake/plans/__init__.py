"""Composed plans: feature tables and models, as pure functions of DataFrames."""
