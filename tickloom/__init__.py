"""tickloom: a PySpark-native engine for event-interval and time-series research."""
