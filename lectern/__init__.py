"""lectern: a PySpark-native engine for cited, versioned knowledge bases."""
