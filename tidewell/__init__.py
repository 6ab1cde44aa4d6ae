"""Tidewell: a time-series analytics engine that compiles to Spark DataFrame plans."""

__version__ = "0.1.0"
