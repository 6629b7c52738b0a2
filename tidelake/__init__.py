"""tidelake: a PySpark-native engine for typed telemetry history."""
