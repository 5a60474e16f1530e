"""PySpark-native analytics for scholarly and web document corpora."""
