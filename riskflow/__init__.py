"""Transaction-risk analytics on Spark: scoring, alerts, triage, service levels, logs and traces."""

__version__ = "0.1.0"
