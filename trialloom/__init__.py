"""Trial-structured event and time-series analytics on PySpark."""
