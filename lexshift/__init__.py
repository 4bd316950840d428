"""lexshift: lexical-shift analytics on Spark DataFrames."""
