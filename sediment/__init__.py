"""Content-defined chunking, routing, decomposition and reuse analytics as Spark DataFrames."""
