"""Feature-space anomaly analytics as Spark DataFrame operators."""
