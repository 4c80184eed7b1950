"""Helpers of the operators: tables, per-worker caches, files, sizes."""

import pickle
import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "cut_and_free", "shared_folder", "table", "keep_rows", "once", "scratch", "ship", "slices", "small_batches", "filesystem", "crc_mod", "small_side", "partitions"]

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a narrow table that may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_and_free(df: DataFrame) -> DataFrame:
    """``cut_lineage``, whose job's shuffle files are removed from the executors once its table is written.

    Spark keeps them until the driver next collects its garbage, which may be
    long after a chain of such tables has filled the disks. Nothing reads them
    again: later steps read the table.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(FREE_SHUFFLES, before)


def once(owner: str, part, version, build):
    """``build()`` the first time a Python worker asks for a version of an owner's part, later the same object.

    Functions travel with their tasks, so a module's globals are new for each
    task; what is costly to build is kept in a module of the worker instead.
    A worker keeps the tools of one operator, its last owner, and of each part
    its last version: what others have left is given back first.
    """
    store = sys.modules.setdefault("_colloquy_worker_cache", types.ModuleType("_colloquy_worker_cache")).__dict__
    if store.get("owner") != owner:
        store["owner"], store["parts"] = owner, {}
    known = store["parts"].get(part)
    if known is None or known[0] != version:
        store["parts"].pop(part, None)
        known = store["parts"][part] = (version, build())
    return known[1]


def ship(spark: SparkSession, thing, owner: str):
    """Broadcast ``thing``, of a size that is fixed, by value; returns what gives it back inside a task."""
    content = cloudpickle.dumps(thing)
    shared, version = spark.sparkContext.broadcast(content), hash(content)
    return lambda: once(owner, "shipped", version, lambda: pickle.loads(shared.value))


def slices(batches, rows=512):
    """Arrow batches in small pieces, so that Python objects of few texts are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keep_rows(df: DataFrame, text_col: str, decider) -> DataFrame:
    """Rows of ``df``, with all its columns, whose text ``decider()(texts)`` keeps. One pass, no shuffle, no join."""
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        keep = decider()
        for batch in slices(batches):
            yield batch.filter(pa.array([bool(k) for k in keep(batch.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of few rows: some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(file system, path) of a shared folder, for Python code in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def arrow_schema(ddl: str):
    """The Arrow schema of rows that a Python function gives back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def crc_mod(column: str, parts: int):
    """crc32 of a column's text, modulo ``parts``: the folds of held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored narrow table for broadcast if its counted rows stay within ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
