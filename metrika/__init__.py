"""Object-measurement analytics and training-data operators on Spark DataFrames."""
