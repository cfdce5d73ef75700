"""lumenfold: a PySpark-native engine for cataloguing files and preparing text corpora."""
