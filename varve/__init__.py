"""varve: Spark-native analytics for irregularly sampled series and text corpora."""
