"""Reading the input tables and writing intermediate tables that survive a lost executor."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder of our own, where the session names none, and the tables written so far.
_own: dict[str, str] = {}
_tables: dict[str, list[str]] = {}
#: The tables written in the block of this thread that asks for them.
_block: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("matrel_tables", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table, read by Spark only, so any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session whose executor is the driver's own process (``local[...]``) gets a temporary folder; on any other,
    which has no folder of which we know that it is shared, this raises before work starts.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="matrel-checkpoint-")
    return _own[context.applicationId]


_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def written(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read again.

    Cuts the lineage: what follows reads the table, so a lost executor costs a
    re-read and not the whole computation. The table stays until ``discard_tables``.
    Shuffle partitions are merged up to the session's advised size, so that small tables are few files; ``heavy``: what follows
    the last shuffle is work that all cores should share, however few bytes it reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/matrel-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_PARALLEL)
    try:
        spark.conf.set(_PARALLEL, "true" if heavy else "false")
        df.write.parquet(path)
    finally:
        spark.conf.set(_PARALLEL, before)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    block = _block.get()
    if block is not None:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths of the intermediate tables that are written in the block."""
    made: list[str] = []
    token = _block.set(made)
    try:
        yield made
    finally:
        _block.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables of which nothing is read any more."""
    held = _tables.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        if path in held:
            held.remove(path)


def discard_tables(spark: SparkSession) -> int:
    """Deletes the intermediate tables this application has written so far and says how many.

    For the end of a run, when its results are stored: results that weren't are read from these tables.
    """
    paths = list(_tables.get(spark.sparkContext.applicationId, []))
    discard(spark, paths)
    return len(paths)
