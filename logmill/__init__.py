"""Web access-log analytics on PySpark: parsing, statistics, per-minute figures, streams."""
