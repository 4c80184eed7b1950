"""Session metadata."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.text import session_id
from colloquy.operators.stats import current_sessions
from colloquy.schemas import SESSIONS
from colloquy.sources.segment_log import read_or_empty


def new_sessions(meetings: DataFrame) -> DataFrame:
    """Session rows from ``meeting_id, start_time, analysis_mode, words_per_analysis``.

    Manual sessions have no threshold; older ones have neither mode nor threshold.
    """
    columns = set(meetings.columns)
    mode = F.col("analysis_mode") if "analysis_mode" in columns else F.lit(None).cast("string")
    words = F.col("words_per_analysis") if "words_per_analysis" in columns else F.lit(None).cast("int")
    return meetings.select(
        session_id("start_time").alias("session_id"), "meeting_id", "start_time", mode.alias("analysis_mode"),
        F.when(mode == "automatic", words).cast("int").alias("words_per_analysis"))


def save_sessions(sessions: DataFrame, path: str) -> None:
    sessions.select(SESSIONS.names).write.mode("append").parquet(path)


def load_sessions(spark: SparkSession, path: str, by="session_id") -> DataFrame:
    """The latest stored row per session (or meeting); empty if nothing is stored."""
    return current_sessions(read_or_empty(spark, path, SESSIONS), by=by)


def with_minutes(feed: DataFrame, sessions: DataFrame, ts="ts") -> DataFrame:
    """A feed, also a streaming one, with the whole ``minutes`` since its meeting began; null without a session.

    A meeting with several sessions began with the first. Sessions are a stored
    table; a stream reads it again for every micro-batch.
    """
    began = sessions.groupBy("meeting_id").agg(F.min("start_time").alias("_began"))
    passed = F.unix_seconds(ts) - F.unix_seconds("_began")
    return feed.join(began, "meeting_id", "left").withColumn(
        "minutes", F.when(passed < 0, F.lit(0)).otherwise(F.floor(passed / 60)).cast("bigint")).drop("_began")
