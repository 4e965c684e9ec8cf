"""Operators: functions from DataFrames of design facts to DataFrames of findings."""
