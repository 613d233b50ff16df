"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiflow.session import fresh_checkpoint_path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    back: lineage is cut, values that depend on the run (row numbers,
    partition numbers) are fixed, and an executor that is lost later takes
    nothing with it."""
    path = fresh_checkpoint_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder behind a frame made by ``materialize`` that no later
    step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def whole_text(text: str | Column) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tagged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(tag, doc)``: each row of ``docs`` as a struct beside a string that
    no other row has: its file and place there.  Both are fixed for a table
    read from files; any other frame is written first."""
    def rows(df):
        place = df.metadataColumn("_metadata")
        return df.select(F.concat_ws(":", place["file_path"], place["row_index"].cast("string")).alias("tag"),
                         F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("doc"))

    try:
        return rows(docs)
    except AnalysisException:                # not read from Parquet files
        return rows(materialize(spark, docs, "tagged"))


def only_tags(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """The documents of ``tagged`` rows whose tag is among ``tags (tag)``."""
    return rows.join(tags, "tag", "left_semi").select("doc.*")
