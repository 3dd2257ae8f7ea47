"""Sinks of the telemetry-anomaly engine."""
