"""Counts of spaces for a stream of proteins. Stateless: each micro-batch is counted on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import batch as B


def count_stream(proteins: DataFrame, build: B.Build, keep) -> DataFrame:
    """The streaming or static rows with n_valid and log10_valid."""
    return B.count_spaces(proteins, build, keep)
