"""Cross-sectional signal research on Spark DataFrames."""
