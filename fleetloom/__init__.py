"""fleetloom: a Spark-native engine for vehicle-tracker telemetry."""

__version__ = "0.1.0"
