"""Relational, retrieval, comparison, cost and evaluation operators: DataFrame to DataFrame."""
