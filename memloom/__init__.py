"""Spectral project memory as PySpark DataFrames."""
