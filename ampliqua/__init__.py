"""Ampliqua: a Spark-native engine for long-read amplicon genotyping tables."""

__version__ = "0.1.0"
