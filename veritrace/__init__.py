"""veritrace: a PySpark-native engine for labelled agent-trajectory data."""

__version__ = "0.1.0"
