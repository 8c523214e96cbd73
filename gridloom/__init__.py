"""gridloom: terrain grids, line graphs and place names as Spark DataFrames."""

__version__ = "0.1.0"
