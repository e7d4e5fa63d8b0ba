"""Scans, sinks and catalog helpers."""
