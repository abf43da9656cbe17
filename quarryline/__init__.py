"""quarryline: a PySpark-native engine for cataloguing, dating and auditing file archives."""

__version__ = "0.1.0"
