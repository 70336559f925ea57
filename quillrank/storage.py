"""Tables written to the folder that all executors share, in place of cached or local copies."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidParameter

#: Rows of a few numbers or words: some 30 MB in a hash table.
SENT_ROWS = 500_000
_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none, a temporary folder that goes with the process, but only if all tasks run in this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise InvalidParameter("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="quillrank-core-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return "file://" + _fallback[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later plans begin at its files, whatever is lost in between."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its ``rows`` are at most ``SENT_ROWS``: Spark doesn't know how small a result will be, and would shuffle what it meets."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` wrote, once nothing will be computed from it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
