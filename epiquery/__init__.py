"""epiquery: a Spark-native analytics engine for outbreak-report text."""

__version__ = "0.1.0"
