"""pinweave: hypergraph analytics and balanced partitioning on PySpark DataFrames."""
