"""Retrieval and graph operators over DataFrames."""
