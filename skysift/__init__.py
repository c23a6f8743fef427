"""Sensor-stream analytics as Spark DataFrame transformations."""
