"""Readers and writers: drawing files, change streams, telemetry, decisions, result sets."""
