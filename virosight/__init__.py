"""Molecular-surveillance analytics on PySpark DataFrames."""
