"""Auxograph: growth-curve analytics and large-table data preparation on Spark DataFrames."""

__version__ = "0.1.0"
