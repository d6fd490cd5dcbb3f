"""Files in and out: delimited text and workbooks. Parquet is Spark's own reader with ``sheet_of``."""
