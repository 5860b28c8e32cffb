"""basalt: distributed profiling, feature engineering and model governance on Spark DataFrames."""
