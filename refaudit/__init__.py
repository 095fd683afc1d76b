"""refaudit: a PySpark-native engine that audits and repairs bibliographic records."""

__version__ = "0.1.0"
