"""Service-fleet telemetry analytics expressed as Spark DataFrame jobs."""
