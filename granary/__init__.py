"""granary: a PySpark-native engine for building, checking and scoring text data sets."""
