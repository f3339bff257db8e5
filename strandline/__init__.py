"""strandline: Spark-native analytics over symbol sequences and event tables."""
