"""A Spark-native engine for sequencing reads held as DataFrames."""
