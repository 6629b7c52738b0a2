"""Sinks of the telemetry engine."""
