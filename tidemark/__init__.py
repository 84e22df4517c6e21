"""Spark-native operators for leakage-safe features on labelled event logs."""
