"""A PySpark-native analytics engine for minute-level market time series."""
