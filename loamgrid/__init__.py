"""Geographically weighted modelling on PySpark DataFrames."""
