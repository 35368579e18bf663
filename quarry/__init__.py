"""Quarry: PySpark-native mining of high-utility itemsets over uncertain transactions."""

__version__ = "0.1.0"
