"""Scans, reshapes and sinks."""
