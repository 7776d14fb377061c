"""A knowledge-graph, retrieval and text-analytics engine on PySpark DataFrames."""
