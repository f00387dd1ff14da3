"""tidemark: bar, label, simulation and statistics operators on Spark DataFrames."""
