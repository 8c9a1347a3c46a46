"""sparkseek: a PySpark-native search and web-analytics engine."""
