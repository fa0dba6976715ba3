"""lensmill: a PySpark-native engine for counting what every review says."""
