"""Day-grain analytics on Spark: sources, operators, functions, plans, streaming."""
