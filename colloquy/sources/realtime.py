"""Routing of a JSON event stream by type; works on batch and streaming frames."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colloquy.fixed_values import EVENT_ROUTES
from colloquy.functions.text import is_blank
from colloquy.schemas import REALTIME_EVENT


def route_events(events: DataFrame, payload="payload") -> DataFrame:
    """Add ``type, item_id, transcript, error`` and ``route``.

    Unknown types go to ``other``, objects without a type to ``untyped``,
    transcripts without a word to ``blank``, anything that is no JSON object to
    ``malformed`` (the stream goes on).
    """
    parsed = events.withColumn("_e", F.from_json(payload, REALTIME_EVENT)).withColumn(
        "_v", F.try_parse_json(payload))
    good = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    out = parsed.withColumn("_good", good)
    for name in REALTIME_EVENT.names:
        out = out.withColumn(name, F.when(F.col("_good"), F.col(f"_e.{name}")))
    known = reduce(lambda w, kv: w.when(F.col("type") == kv[0], kv[1]), EVENT_ROUTES.items(), F)
    route = F.when(~F.col("_good"), "malformed").when(F.coalesce("type", F.lit("")) == "", "untyped") \
        .otherwise(F.coalesce(known, F.lit("other")))
    blank = F.coalesce(is_blank("transcript"), F.lit(True))
    out = out.withColumn("route", F.when((route == "completed") & blank, "blank").otherwise(route))
    return out.drop("_e", "_v", "_good")


def transcripts(routed: DataFrame) -> DataFrame:
    """The transcript stream, texts as they came."""
    return routed.filter(F.col("route") == "completed").withColumnRenamed("transcript", "text")


def quarantine(routed: DataFrame) -> DataFrame:
    """Reported errors and malformed messages."""
    return routed.filter(F.col("route").isin("error", "malformed"))
