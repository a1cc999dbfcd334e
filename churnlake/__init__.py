"""Customer-churn analytics on Spark: quality, features, models and drift at table scale."""

__version__ = "0.1.0"
