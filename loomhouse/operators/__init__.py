"""Warehouse operators on DataFrames: star schema, history, fan-out, snapshots and checks."""
