"""The ordered segment log of all meetings, as an append-only table."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.schemas import SEGMENTS

_STORED = T.StructType(list(SEGMENTS.fields) + [T.StructField("epoch", T.IntegerType())])
_CLEARED = T.StructType([
    T.StructField("meeting_id", T.LongType()), T.StructField("epoch", T.IntegerType())])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, optional=True) -> DataFrame:
    """A parquet table, or an empty one with its schema while nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if not optional or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class SegmentLog:
    """Segments stored under ``path``, spread over ``buckets`` folders by meeting.

    One folder per meeting would mean millions of tiny files; a bucket column
    computed from the meeting still lets a read of one meeting skip the other
    folders. Clearing a meeting appends a marker instead of rewriting data:
    rows written in an epoch up to the marker's are void, later ones count.
    :meth:`compact` writes a log without void rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._rows, self._marks = f"{path}/segments", f"{path}/cleared"

    def _bucket(self, meeting):
        return F.pmod(F.xxhash64(meeting), F.lit(self.buckets)).cast("int")

    def _cleared(self) -> DataFrame:
        return read_or_empty(self.spark, self._marks, _CLEARED)

    def epoch(self) -> int:
        return (self._cleared().agg(F.max("epoch")).first()[0] or 0) + 1

    def append(self, segments: DataFrame) -> None:
        rows = segments.select("meeting_id", "seq", "text").withColumn("epoch", F.lit(self.epoch()))
        rows = rows.withColumn("bucket", self._bucket(F.col("meeting_id")))
        # Rebalancing gathers a bucket's rows into few files, yet splits any
        # partition that grows too large, however many rows one meeting has.
        rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self._rows)

    def read(self, meeting_id: int | None = None) -> DataFrame:
        """Live segments; order by ``seq`` where order matters."""
        rows = read_or_empty(self.spark, self._rows, T.StructType(
            list(_STORED.fields) + [T.StructField("bucket", T.IntegerType())]))
        if meeting_id is not None:
            one = F.lit(meeting_id).cast("bigint")
            rows = rows.filter((F.col("bucket") == self._bucket(one)) & (F.col("meeting_id") == one))
        marks = self._cleared().groupBy("meeting_id").agg(F.max("epoch").alias("_until"))
        live = rows.join(marks, "meeting_id", "left").filter(F.col("_until").isNull() | (F.col("epoch") > F.col("_until")))
        return live.select("meeting_id", "seq", "text")

    def clear(self, meetings: DataFrame) -> None:
        """Void all stored segments of the given meetings."""
        epoch = self.epoch()
        meetings.select("meeting_id").distinct().withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(self._marks)

    def compact(self, path: str) -> "SegmentLog":
        """Write the live segments to a new log at ``path``."""
        fresh = SegmentLog(self.spark, path, self.buckets)
        fresh.append(self.read())
        return fresh

    def stream(self, files_per_trigger: int = 64) -> DataFrame:
        """Segments as they are appended, cleared ones too; each is read once per query checkpoint. See :meth:`feed`."""
        schema = T.StructType(list(_STORED.fields) + [T.StructField("bucket", T.IntegerType())])
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(self._rows)
        return rows.select("meeting_id", "seq", "text")

    def feed(self, files_per_trigger: int = 64) -> DataFrame:
        """A streaming feed of the log: its segments and a ``clear`` row, without a position, for each marker.

        Rows carry their ``epoch``. The live operators void what a marker
        voids, in whatever order files arrive, and begin cleared meetings anew.
        """
        read_or_empty(self.spark, self._marks, _CLEARED).limit(0).write.mode("append").parquet(self._marks)    # the folder has to be there
        schema = T.StructType(list(_STORED.fields) + [T.StructField("bucket", T.IntegerType())])
        source = self.spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        none = lambda kind: F.lit(None).cast(kind)
        rows = source.schema(schema).parquet(self._rows).select(
            "meeting_id", "seq", F.lit("segment").alias("event"), "text", F.lit(True).alias("auto"), none("int").alias("value"), "epoch")
        marks = source.schema(_CLEARED).parquet(self._marks).select(
            "meeting_id", none("bigint").alias("seq"), F.lit("clear").alias("event"), none("string").alias("text"), F.lit(True).alias("auto"),
            none("int").alias("value"), "epoch")
        return rows.unionByName(marks)

    def live(self, rows: DataFrame) -> DataFrame:
        """Of a table made from the log, with ``meeting_id`` and ``epoch``, the rows that later markers have not voided."""
        marks = self._cleared().groupBy("meeting_id").agg(F.max("epoch").alias("_until"))
        joined = rows.join(marks, "meeting_id", "left")
        return joined.filter(F.col("_until").isNull() | (F.col("epoch") > F.col("_until"))).drop("_until")
