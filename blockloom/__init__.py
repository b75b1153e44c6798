"""Block-storage analytics on Spark: DataFrame in, DataFrame out."""
