"""Table sources and sinks.

Reads are plain ``spark.read`` calls so Catalyst prunes columns and pushes
filters into the Parquet (or JDBC) scan.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream (S3 stand-in for a topic).  A file
    stream source lists a folder or a glob, so the one file is named by a
    glob that matches only it; new files matching it arrive as new batches."""
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, f"[{name[0]}]{name[1:]}.parquet"))


def documents_of_company(documents: DataFrame, krs: str, key: str = "krs_number",
                         columns=("hash_id",)) -> DataFrame:
    """Stored documents of one company, only the needed columns (the
    equality filter and the projection both reach the scan; bytes are never
    read)."""
    return documents.filter(F.col(key) == F.lit(krs)).select(*columns)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str,
                 partition_by: list[str] | None = None) -> None:
    """Create the table when missing (no rows, fixed schema)."""
    if spark.catalog.tableExists(name):
        return
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{part} LOCATION '{path}'")


def append_versions(df: DataFrame, path: str, created_col: str = "record_created_at",
                    key: str = "krs_number") -> None:
    """Append raw extract versions to the history, partitioned by the day
    they were taken, so readers prune days and writers never rewrite files.

    Range partitioning on (day, company) before the write: tasks stay
    balanced even when one day is most of the batch, each writes few files,
    and files are sorted by company, so one company's read skips most row
    groups by their min/max statistics."""
    (df.withColumn("ingest_day", F.to_date(F.col(created_col)))
       .repartitionByRange("ingest_day", key).sortWithinPartitions("ingest_day", key)
       .write.mode("append").partitionBy("ingest_day").parquet(path))


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               properties: dict | None = None) -> None:
    """A JDBC sink (PostgreSQL in production; embedded Derby in tests)."""
    df.write.jdbc(url=url, table=table, mode=mode, properties=properties or {})


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int = 0, upper: int = 0, num_partitions: int = 1,
              properties: dict | None = None) -> DataFrame:
    """S1 over JDBC: range-partitioned on a numeric id so many tasks read."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                               upperBound=upper, numPartitions=num_partitions,
                               properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


# --- document store ----------------------------------------------------------
# Records and contents are stored apart (listings never read bytes), both
# partitioned by the first two hex digits of the content key (256 folders) and
# sorted by key inside each folder.  A request for a few keys then reads only
# the folders of their prefixes (a partition filter built from the request's
# prefixes - at most 256 values, so collecting them is bounded), and Parquet
# min/max statistics on the sorted key skip most row groups inside.

PREFIX = "hash_prefix"


def hash_prefix(key: str = "hash_id"):
    return F.substring(F.col(key), 1, 2)


def write_documents(records: DataFrame, contents: DataFrame, root: str, mode: str = "append") -> None:
    """Append document records and their contents to the store at ``root``.

    Range partitioning on (prefix, key): every task writes a contiguous,
    sorted key range, so a large batch is written by as many tasks as the
    shuffle has (not one per prefix) and each file's min/max statistics on
    ``hash_id`` cover a narrow range."""
    for name, df in (("records", records), ("contents", contents)):
        (df.withColumn(PREFIX, hash_prefix())
           .repartitionByRange(PREFIX, "hash_id").sortWithinPartitions(PREFIX, "hash_id")
           .write.mode(mode).partitionBy(PREFIX).parquet(os.path.join(root, name)))


def read_store(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, name))


def prefixes_of(df: DataFrame, key: str = "hash_id") -> list[str]:
    """Distinct key prefixes of a request or batch: at most 256 values (two
    hex digits), the one collect in this package, bounded by construction."""
    return [r[0] for r in df.select(hash_prefix(key).alias(PREFIX)).distinct().collect()]


def by_keys(stored: DataFrame, request: DataFrame, key: str = "hash_id",
            prefixes: list[str] | None = None) -> DataFrame:
    """Stored rows whose key is in a request list (J2 on the store): only the
    folders of the request's prefixes are read, then a semi-join on
    (prefix, key)."""
    prefixes = prefixes_of(request, key) if prefixes is None else prefixes
    pruned = stored.filter(F.col(PREFIX).isin(prefixes))
    req = request.select(key).withColumn(PREFIX, hash_prefix(key))
    return pruned.join(req, [PREFIX, key], "left_semi")


def stored_keys_near(stored: DataFrame, incoming: DataFrame, key: str = "hash_id",
                     prefixes: list[str] | None = None) -> DataFrame:
    """The stored keys that share a prefix with an incoming batch - the only
    ones an insert-if-absent or missing-key anti-join can hit - read from
    those folders only."""
    prefixes = prefixes_of(incoming, key) if prefixes is None else prefixes
    return stored.filter(F.col(PREFIX).isin(prefixes)).select(key)


# --- published snapshots ------------------------------------------------------
# A derived table (e.g. the current row of every company) is written to a new
# folder per version; a one-row pointer is appended to ``<root>/_pointers``
# only after the folder is complete.  Readers follow the newest pointer, so a
# reader never sees a half-written snapshot and no table is ever rewritten in
# place (Spark's built-in tables have no MERGE).


def publish_snapshot(df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as snapshot ``version`` and then point readers at it.

    Every attempt writes a folder of its own, so none deletes what ``df``, a
    reader or another attempt still reads.  A version that is published stays
    as it is: publishing it again is an error."""
    spark = df.sparkSession
    if published_version(spark, root) >= version:
        raise ValueError(f"snapshot {version} or a later one is published at {root}")
    path = os.path.join(root, f"v={version}-{uuid.uuid4().hex[:12]}")
    df.write.partitionBy(*partition_by).parquet(path)
    pointer = spark.createDataFrame([(int(version), path)], "version long, path string")
    pointer.write.mode("append").parquet(os.path.join(root, "_pointers"))
    return path


def published_version(spark: SparkSession, root: str) -> int:
    """The version of the newest published snapshot, -1 where there is none."""
    try:
        return spark.read.parquet(os.path.join(root, "_pointers")).agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
    except AnalysisException:
        return -1


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest published snapshot (one small aggregate over the pointer
    rows, then a plain read)."""
    newest = spark.read.parquet(os.path.join(root, "_pointers")).agg(F.max_by("path", "version")).first()[0]
    return spark.read.parquet(newest)


def forget_snapshots(spark: SparkSession, root: str) -> int:
    """Delete the folders of versions older than the newest published one,
    those of attempts that broke off included, when no reader uses them any
    more; returns how many."""
    newest, gone = published_version(spark, root), 0
    for path in folders_in(spark, root):
        name = re.fullmatch(r"v=(\d+)-[0-9a-f]+", path.rstrip("/").rsplit("/", 1)[1])
        if name and int(name[1]) < newest:
            delete_folder(spark, path)
            gone += 1
    return gone


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """The folders right below ``path``, none where it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in system.listStatus(folder) if f.isDirectory()] if system.exists(folder) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# --- store bucketed by content key ---------------------------------------------
# A catalog table clustered by ``hash_id``, a digest, so no bucket is hot.  A
# batch is shuffled to the buckets; the stored side is read bucket by bucket
# and never moves, however large it has become.


def ensure_bucketed_table(spark: SparkSession, name: str, schema: T.StructType, path: str, buckets: int,
                          key: str = "hash_id") -> None:
    """Create the store when missing.  With at least as many buckets as
    ``spark.sql.shuffle.partitions`` a join follows the buckets."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")


def absent_from(incoming: DataFrame, name: str, key: str = "hash_id") -> DataFrame:
    """The rows of ``incoming`` whose key the store ``name`` does not hold."""
    return incoming.join(incoming.sparkSession.table(name).select(key), key, "left_anti")


def insert_absent(incoming: DataFrame, name: str, buckets: int, key: str = "hash_id") -> None:
    """Append the rows of ``incoming`` (one per key) that the store does
    not hold; a rerun appends nothing.  One task writes a bucket."""
    spark = incoming.sparkSession
    fresh = absent_from(incoming, name, key).select(*spark.table(name).columns)
    fresh.repartition(buckets, key).sortWithinPartitions(key).write.insertInto(name)
    spark.catalog.refreshTable(name)
