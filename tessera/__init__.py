"""tessera: a Spark-native engine for document, configuration, run and detection data."""
