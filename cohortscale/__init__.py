"""Cohort evaluation on Spark: splits, mask metrics, grouped statistics, reconciliation, logs."""
