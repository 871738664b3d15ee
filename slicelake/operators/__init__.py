"""Operators: functions from DataFrames to DataFrames over the canonical tables."""
