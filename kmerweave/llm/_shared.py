"""Tables staged between stages of an operator, and hash folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="kmerweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so lost executors cost only their own tasks, and it
    makes results that are read twice consistent.  The folder is deleted when
    the application ends, or by ``drop`` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more, such as the last round's of a loop."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place, files = _place(df.sparkSession, path)
        files.delete(place, True)


def named(df: DataFrame, *without: str) -> list[Column]:
    """The columns of a table, whatever characters their names have."""
    return [F.col(quoted(c)) for c in df.columns if c not in without]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the labelled operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
