"""recordlake: Spark-native analytics over long-lived, schemaless record archives."""
