"""A PySpark-native property-graph analytics engine."""
