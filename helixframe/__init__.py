"""helixframe: sequence, interval and record analytics as Spark DataFrames."""
