"""Analytics over libraries of long, structured documents, on Spark DataFrames."""
