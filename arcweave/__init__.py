"""Spark-native analytics for transport and trade networks."""
