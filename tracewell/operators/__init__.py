"""Relational, graph and routing operators over DataFrames."""
