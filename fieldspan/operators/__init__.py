"""Sensor-series, catalogue, attribute and text operators."""
