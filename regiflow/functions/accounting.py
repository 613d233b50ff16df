"""Accounts of rows: in, out and rejected by reason, counted while the rows are
written (``DataFrame.observe``), not by another pass.

Counts of an observation are those of the tasks that ran: observe a frame that
one plain pass reads (a write without a shuffle above it), not one whose rows
are also sampled for a range partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def accounted(df: DataFrame, reasons: Sequence[str], reason: str = "reason") -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted as it is read: all, those without a
    ``reason``, and those of each of ``reasons`` (a name that ends with ``*``
    stands for all reasons that begin so)."""
    def hit(name: str):
        return F.col(reason).startswith(name[:-1]) if name.endswith("*") else F.col(reason) == name

    seen = Observation()
    counts = [F.count_if(hit(n)).alias(n) for n in reasons]
    return df.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col(reason).isNull()).alias("rows_out"), *counts), seen


def account_of(seen: Observation) -> list[tuple[str, int]]:
    """``(outcome, rows)`` of an observed frame that has been read: ``in``,
    ``out`` and each reason.  An error if a row is in none of them."""
    counts = seen.get
    reasons = [(k, v) for k, v in counts.items() if k not in ("rows_in", "rows_out")]
    if counts["rows_in"] != counts["rows_out"] + sum(v for _, v in reasons):
        raise RuntimeError(f"rows in are not rows out and rejected: {counts}")
    return [("in", counts["rows_in"]), ("out", counts["rows_out"]), *reasons]
