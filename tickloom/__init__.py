"""Chart-token and corpus analytics on PySpark DataFrames."""
