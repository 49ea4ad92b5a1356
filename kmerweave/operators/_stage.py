"""Written tables between stages, and broadcasts of a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

#: Rows that a side of a join may have to be broadcast.
BROADCAST_ROWS = 1_000_000


def stage_root(spark: SparkSession) -> str:
    """The folder of written tables, which the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kmerweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage of loops; the folder is deleted when the application ends,
    or by ``drop`` before.  Where the setting is unset, a temporary folder serves runs
    in one process; on a cluster it must be set, as executors don't share their own
    folders.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, Row]:
    """The staged table and aggregates over it, which come with the write instead of in a job of their own."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in what.items())), name)
    return out, Row(**seen.get)


def drop(*tables: DataFrame | None) -> None:
    """Delete the folders of staged tables that nothing reads any more, such as those of a loop's last round."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
            place, files = _place(df.sparkSession, path)
            files.delete(place, True)


class Parts:
    """A table that a loop adds rows to: one folder, so its plan doesn't grow with the rounds."""

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self.spark, self.schema = spark, schema
        self.path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)
        place, files = _place(spark, self.path)
        files.deleteOnExit(place)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table written and counted: to be broadcast if it has at most ``rows`` rows, to be shuffled if it has more.

    For narrow tables (keys and numbers) that are the small side of a join.
    """
    out = staged(df, "side")
    return F.broadcast(out) if out.count() <= rows else out.hint("merge")
