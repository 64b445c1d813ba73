"""tidewheel: exchange-centred analytics on PySpark DataFrames."""
