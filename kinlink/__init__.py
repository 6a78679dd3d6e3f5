"""kinlink: a PySpark-native record-linkage and analytics engine."""
