"""Web-corpus analytics on PySpark: DataFrames in, DataFrames out."""
