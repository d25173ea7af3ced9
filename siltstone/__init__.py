"""Log-template mining, time series, session patterns and a block store, as Spark DataFrames."""
