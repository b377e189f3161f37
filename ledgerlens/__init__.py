"""Transaction analytics on Spark DataFrames: history features, population statistics, profiling, splits, models and metrics."""
