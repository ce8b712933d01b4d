"""gaugeflow: dated measurement analytics on Spark DataFrames."""
