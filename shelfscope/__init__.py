"""Daily retail sales analytics on Spark: contracts, star schema, KPIs, features, forecasts and run-log analytics."""

__version__ = "0.1.0"
