"""Spark-native grounding, verification and corpus-preparation engine."""

__version__ = "0.1.0"
