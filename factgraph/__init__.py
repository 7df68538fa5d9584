"""factgraph: source-code facts, graphs and rules as PySpark DataFrames."""
