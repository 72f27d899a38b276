"""Operators over DataFrames: statistics, issue rules, chunks and retrieval."""
