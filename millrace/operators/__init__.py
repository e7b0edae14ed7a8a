"""Operators: functions from DataFrames to DataFrames, with column names as parameters."""
