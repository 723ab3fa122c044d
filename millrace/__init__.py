"""Millrace: document, time-series and scoring operators for Apache Spark."""
