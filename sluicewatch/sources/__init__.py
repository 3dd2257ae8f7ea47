"""Sources of the telemetry-anomaly engine."""
