"""Operators: DataFrame -> DataFrame, lazy, declared with the DataFrame API."""
