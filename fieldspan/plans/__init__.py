"""Whole jobs, and queries over the test tables with their SQL."""
