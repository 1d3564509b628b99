"""Spending analytics on Spark: DataFrame operators over ledgers, surveys, predictions and feedback."""

__version__ = "0.1.0"
