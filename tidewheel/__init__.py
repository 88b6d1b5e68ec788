"""tidewheel: deterministic analytics over time-ordered event streams, compiled to Spark DataFrames."""
