"""lodestone: a PySpark-native engine for software-architecture analytics."""
