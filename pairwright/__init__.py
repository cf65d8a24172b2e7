"""Build and audit paired before/after evidence datasets with Spark DataFrames."""
