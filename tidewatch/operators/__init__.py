"""Detectors, reads and rollups over events."""
