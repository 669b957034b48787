"""A PySpark-native analytics engine for market-data event streams."""
