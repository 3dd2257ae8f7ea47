"""Spark-native anomaly detection over industrial control telemetry."""

__version__ = "0.1.0"
