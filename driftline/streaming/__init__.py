"""Structured Streaming counterparts of the change and telemetry operators."""
