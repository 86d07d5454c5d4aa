"""A PySpark-native analytics engine for labelled metrics and time series."""

__version__ = "0.1.0"
