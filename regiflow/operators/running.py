"""Running sums per key without a window over the key.

A window ``sum() OVER (PARTITION BY company ORDER BY ...)`` puts a company into
one task.  Here the rows are ranged by (key, order), so a key with a third of
all rows lies in many partitions:

1. each partition sums what it holds of a key, in order;
2. the totals per (key, partition), a row or so for each key and for each
   partition, are summed in partition order: what a partition carries over;
3. the carried sums, only those that are not zero, are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiflow.session import fresh_checkpoint_path

_PART = "_part"


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for every ``name: value`` of ``sums``, the sum of the
    values of the rows before it of its key, as a long.

    ``order`` must tell the rows of a key apart; null values count as 0.  The
    rows are written once, as a place in a range partition is not fixed
    otherwise, so ``df`` should be narrow."""
    spark, keys, order = df.sparkSession, list(keys), list(order)
    names = {name: f"_own_{name}" for name in sums}
    valued = df.select("*", *[F.coalesce(v.cast("long"), F.lit(0)).alias(names[n]) for n, v in sums.items()])
    ranged = valued.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id())
    path = fresh_checkpoint_path(spark, "running_sums")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)

    here = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(names[n]).over(here), F.lit(0)).alias(n) for n in sums])
    totals = rows.groupBy(*keys, _PART).agg(*[F.sum(names[n]).alias(f"_total_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(_PART).alias("_at"),
                            *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_carried_{n}") for n in sums])
    some = None
    for n in sums:
        some = F.col(f"_carried_{n}") != 0 if some is None else some | (F.col(f"_carried_{n}") != 0)
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col(_PART) == F.col("_at")]
    joined = local.join(carried.filter(some), on, "left")
    return joined.select(*[F.col(c) for c in df.columns],
                         *[(F.col(n) + F.coalesce(F.col(f"_carried_{n}"), F.lit(0))).alias(n) for n in sums])
