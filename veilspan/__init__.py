"""Personal-data detection, redaction, restoration and audit on Spark DataFrames."""
