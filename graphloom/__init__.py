"""PySpark-native code-intelligence and graph analytics over symbol and edge tables."""
