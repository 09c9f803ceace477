"""Spark-native detection, redaction and auditing of sensitive data in text."""

__version__ = "0.1.0"
