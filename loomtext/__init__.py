"""loomtext: document text analytics on Spark, one row per document."""
