"""Session helpers."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app="colloquy", cpus="*", **conf):
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_folders = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names it. Only where that is unset (a local test
    session) a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        # One folder per application, to be removed when it has ended.
        return f"{folder.rstrip('/')}/colloquy-{context.applicationId}"
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="colloquy-")
    return _local_folders[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from that table.

    Unlike a checkpoint this runs the plan once, and later reads fetch only
    the columns and rows they need.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Give costly per-row work all cores where the input has too few splits.

    Stored tables of any size have more splits than this and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < min(cores, 64) else df
