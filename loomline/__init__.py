"""loomline: a PySpark-native engine for narrative text, entity state, dialogue data and evaluation."""
