"""Speech-annotation analytics as composable Spark operators: functions from DataFrames to DataFrames."""
