"""Spark-native analytics over offset-well records, report text and rig-sensor streams."""
