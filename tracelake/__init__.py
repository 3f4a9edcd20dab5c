"""Process mining and training-data preparation on PySpark DataFrames."""
