"""Functions of the telemetry-anomaly engine."""
