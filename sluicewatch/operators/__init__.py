"""Operators of the telemetry-anomaly engine."""
