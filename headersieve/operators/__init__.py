"""Operators over header logs: DataFrame in, DataFrame out."""
