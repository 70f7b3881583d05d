"""Content analytics and corpus preparation on PySpark DataFrames."""
