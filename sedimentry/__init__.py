"""Drift-aware analytics on PySpark: schema reconciliation, validation, feedback, provenance, telemetry."""
