"""Structured Streaming forms of the telemetry and incident operators."""
