"""spanforge: interval, dataflow and table analytics on PySpark DataFrames."""
