"""paperloom: Spark-native extraction of structured records from tables of positioned words."""

__version__ = "0.1.0"
