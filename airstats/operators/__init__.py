"""Relational operators: DataFrame in, DataFrame out. Columns are named by parameters."""
