"""PySpark-native engine for collision-event tables."""
