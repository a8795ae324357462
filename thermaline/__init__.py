"""Sensor time-series analytics on Spark: ingest, bin, roll up, analyse, audit, curate."""

__version__ = "0.1.0"
