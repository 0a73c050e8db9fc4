"""Small files beside a corpus: lists of sources, probes, flagged sources, glossaries, verdict and result stores, metrics.

Stores are folders of Parquet in shared storage, written as a whole under a new version and read at the newest one, so that a
lost or repeated task leaves no half of it; metrics and progress are appended as JSON lines.
Defined results: a store, probe or glossary that does not exist is an empty one; blank and malformed lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T

STORE = "key string, text string, align array<struct<t0:int,t1:int,w:array<int>>>, q double"
VERDICTS = "key string, ok boolean, why string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(n.getName()[1:]) for n in names if n.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def read_store(spark: SparkSession, path: str, schema: str = STORE) -> DataFrame:
    """The newest whole version of a store."""
    found = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def write_store(df: DataFrame, path: str) -> None:
    """A new version of a store; older ones stay readable for jobs that have begun with them."""
    found = _versions(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}/v{(found[-1] if found else 0) + 1}")


def upsert(spark: SparkSession, path: str, new: DataFrame, schema: str = STORE) -> None:
    """The store with the new rows in place of those of their keys."""
    old = read_store(spark, path, schema)
    write_store(old.join(new.select("key"), "key", "left_anti").unionByName(new.dropDuplicates(["key"])), path)


def invalidate(spark: SparkSession, path: str, keys: DataFrame, schema: str = STORE) -> int:
    """Deletes results by key; returns how many."""
    old = read_store(spark, path, schema)
    left = old.join(keys.select("key").distinct(), "key", "left_anti")
    gone = old.count() - left.count()
    if gone:
        write_store(left, path)
    return gone


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """src: a JSON array of strings, or one a line."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(T.sources_listed("value")).alias("src")).distinct()


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """src, expr of a JSON array of objects; ones without either go."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "src string, expr string")
    return spark.read.schema("src string, expr string").json(path, multiLine=True).where("coalesce(src, '') <> '' and coalesce(expr, '') <> ''")


def write_flagged(flagged: DataFrame, path: str) -> None:
    """The flagged sources, each once and sorted, as JSON lines in ordered files."""
    flagged.select("src").distinct().orderBy("src").write.mode("overwrite").json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """One JSON line a request: stamped in UTC with milliseconds."""
    rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).write.mode("append").json(path)
