"""Operators over particle tables: every one takes and returns DataFrames."""
