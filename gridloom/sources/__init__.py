"""Scans, sinks, and the panel derived from event tables."""
