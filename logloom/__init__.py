"""Log analytics on Spark DataFrames: parse log files, search, summarise and export them."""
