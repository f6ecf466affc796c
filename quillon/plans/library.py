"""Imports every module that registers queries."""

from quillon.plans import q_arrays, q_extra, q_metrics, q_partition, q_sampling, q_series, q_signals  # noqa: F401

FLAGSHIP = "split_crosstab"
