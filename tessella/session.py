"""Session settings, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_session(cores: str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the directory holds one Parquet file or folder a table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is set only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if found is None and jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if found is None:
        found = os.path.join(tempfile.gettempdir(), "tessella-checkpoints")
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not jsc.getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, eager: bool = True, estimate: bool = True) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder. A checkpoint keeps its plan's estimated size, and
    joins multiply estimates. A loop that joins what it cut goes without (estimate=False): the number would have 2.6 times the
    digits after each round, until it alone fills the driver's memory."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager)
    if estimate:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().analyzed().rdd(), out._jdf.schema(), False), spark)


def latest(df: DataFrame, key: str, stamp: str = "loaded_at", within: list[str] | None = None) -> DataFrame:
    """One row a key, the one loaded last; redelivered rows go. Rows travel once, by the key, and stay so for a later join on it.
    within: columns that rows of one key share and by which they are together already. Without the stamp any one of equal keys
    stays, the least by its hash."""
    order = [F.col(stamp).desc_nulls_last()] if stamp in df.columns else []
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    w = Window.partitionBy(*(within or []), key).orderBy(*order, F.xxhash64(*plain))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
