"""Contest analytics on Spark: DataFrame operators for pairwise events."""
