"""Telemetry and evidence analytics as PySpark DataFrame functions."""
