"""Relational, window, coverage and geometry operators: DataFrame in, DataFrame out."""
