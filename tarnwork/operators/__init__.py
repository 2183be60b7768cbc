"""Relational, retrieval and data-cleaning operators; each takes and returns DataFrames."""
