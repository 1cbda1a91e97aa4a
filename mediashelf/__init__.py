"""Media and document library analytics on Spark: DataFrame in, DataFrame out."""
