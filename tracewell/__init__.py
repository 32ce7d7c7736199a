"""Evidence-timeline analytics on Spark: interval, sequence, time and integrity operators as DataFrames."""
