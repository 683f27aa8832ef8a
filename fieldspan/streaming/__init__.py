"""Operators that follow a stream."""
