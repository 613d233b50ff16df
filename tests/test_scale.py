"""Plan properties the scale design relies on.

* per-company answers use partial aggregation, never a window over the
  company (a hot company would be one task);
* no plan has a cartesian product or nested-loop join;
* with one company holding a third of all rows and broadcast off, AQE splits
  the hot company's join partition across tasks;
* scans read only the columns they need.
"""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from regiflow.operators import versions
from regiflow.queries import QUERIES
from regiflow.session import fresh_checkpoint_path


def plan_of(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["current_flag", "current_company", "first_found_registry",
                                  "next_pending_documents", "insert_new_documents", "job_status",
                                  "changed_companies", "documents_per_company"])
def test_per_company_answers_aggregate_partially(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "Window" not in plan
    # an aggregate runs on the map side, right below the shuffle
    assert re.search(r"Exchange \(\d+\)\n[\s:|]*\+- (Hash|Sort|ObjectHash)Aggregate", plan)


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if not k.startswith("stream_")))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_projection_reaches_the_scan(spark):
    plan = plan_of(E.queries()["documents_per_company"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    plan = plan_of(E.queries()["new_documents"](spark, SF_SMALL))
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]     # texts are never read


def test_hot_company_is_split_by_aqe(spark):
    n = 300_000
    df = spark.range(n, numPartitions=8).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 5000).cast("string")).alias("krs_number"),
        F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("record_created_at"),
        F.lit("{}").alias("raw_data"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = versions.mark_current(df, "krs_number", ["record_created_at", "id"])
        # every row kept and flagged: the join back is on the company alone
        summary = out.agg(F.count(F.lit(1)).alias("rows"),
                          F.sum(F.col("is_current").cast("int")).alias("current"),
                          F.max(F.when(F.col("is_current") & (F.col("krs_number") == "HOT"), F.col("id"))).alias("hot"))
        row = summary.collect()[0]
        hot_latest = max(i for i in range(n) if i % 3 == 0)
        assert (row.rows, row.current, row.hot) == (n, 5001, hot_latest)
        final = summary._jdf.queryExecution().executedPlan().toString()    # the plan AQE ran
        assert "isFinalPlan=true" in final and "SortMergeJoin(skew=true)" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_filters_pass_below_a_content_key(spark):
    """A key column is deterministic: a filter above it reaches the scan."""
    from regiflow.queries import stored_documents

    plan = plan_of(stored_documents(spark, SF_SMALL).filter(F.col("o_orderkey") == 5))
    assert "EqualTo(o_orderkey,5)" in plan.split("PushedFilters")[1].split("\n")[0]


def test_archives_move_contents_once(spark):
    """With stored sizes and broadcast off: one scan of the contents, and no
    content in the scan of the manifest."""
    from regiflow.operators import archives

    names = "krs_number string, hash_id string, document_content_save_name string, n_bytes long"
    path = f"{fresh_checkpoint_path(spark, 'test-archives')}"
    spark.createDataFrame([("1", "a", "x", 3), ("1", "b", "y", 4)], names).write.parquet(f"{path}/records")
    spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"abcd"))], "hash_id string, document_content binary") \
        .write.parquet(f"{path}/contents")
    records, contents = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/contents")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        built = archives.build_from_store(records, contents, part_bytes=3)
        plan = plan_of(built)
        assert len(re.findall(r"ReadSchema: struct<[^\n]*document_content:binary", plan)) == 1
        assert "document_content:binary" not in plan_of(archives.manifest(records))
        assert sum(r.n_entries for r in built.collect()) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
