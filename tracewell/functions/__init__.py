"""Scalar functions as Columns, and the template miner."""
