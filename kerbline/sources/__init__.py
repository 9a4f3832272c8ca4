"""Scans, event contracts and sinks."""
