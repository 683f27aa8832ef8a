"""Sensor-series analytics as composable DataFrame -> DataFrame transforms."""
