"""Operators: DataFrame in, DataFrame out. No session is created and nothing is collected."""
