"""Interval-annotation analytics as plain DataFrame functions."""

__version__ = "0.1.0"
