"""Palimpsest: versioned, ordered key-value analytics on PySpark DataFrames."""
