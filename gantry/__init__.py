"""Spark-native analytics for multichannel robot telemetry."""
