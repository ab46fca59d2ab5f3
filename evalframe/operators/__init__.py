"""Grouped operators: every function takes DataFrames plus key columns and
returns a DataFrame; nothing is collected to the driver."""
