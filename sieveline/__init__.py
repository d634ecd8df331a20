"""sieveline: selective-classification, forensic-signal and corpus analytics on Spark."""

__version__ = "0.1.0"
