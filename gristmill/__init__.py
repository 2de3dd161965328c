"""Spark-native analytics over a denormalised ad-event table."""
