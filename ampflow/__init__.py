"""Smart-meter analytics and forecasting on Spark: DataFrames in, DataFrames out."""
