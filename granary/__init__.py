"""granary: document analytics on Spark DataFrames."""
