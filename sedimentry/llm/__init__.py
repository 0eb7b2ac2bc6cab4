"""Operators for preparing training corpora: each takes DataFrames and returns DataFrames."""
