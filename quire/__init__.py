"""quire — corpus profiling and context building on Spark DataFrames.

Tables carry one row per file, line, sentence, cell, path node, symbol or
call; every operator is a DataFrame -> DataFrame function that Catalyst
plans.  See README.md for the operator map.
"""

__version__ = "0.1.0"
