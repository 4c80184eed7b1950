"""Overlapping chunks of an ordered measure (samples, words, bytes …)."""

from pyspark.sql import DataFrame, functions as F

from colloquy.fixed_values import CHUNK_SAMPLES, FLUSH_SAMPLES, OVERLAP_SAMPLES
from colloquy.operators.blocks import BITS, SUPER_BITS, top_of
from colloquy.operators.running import with_running
from colloquy.operators.trigger import reset_trigger


def overlapping_chunks(df: DataFrame, keys, order: str, size: str, chunk=CHUNK_SAMPLES, overlap=OVERLAP_SAMPLES,
                       flush=FLUSH_SAMPLES, flush_only_new=False, top=None, bits=BITS, super_bits=SUPER_BITS) -> DataFrame:
    """Chunks as half-open ranges ``[start, end)`` of the grown measure.

    A chunk is emitted once ``chunk`` has gathered and keeps its last
    ``overlap`` for the next one. At the end a rest above ``flush`` is emitted
    too (``flush=None`` drops it); ``flush_only_new`` leaves out a rest that is
    nothing but the overlap of the chunk before it.
    """
    if not 0 <= overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    keys = list(keys)
    top = top_of(df, order) if top is None else top
    run = reset_trigger(df, keys, order, size, chunk, reset=overlap, top=top, bits=bits, super_bits=super_bits)
    emitted = run.fires().select(
        *keys, F.col("fire_no").alias("chunk_no"), (F.col("total") - F.col("since")).alias("start"),
        F.col("total").alias("end"), F.lit(False).alias("flushed"))
    if flush is None:
        return emitted
    rest = F.col("since") > flush
    if flush_only_new:
        rest &= (F.col("fires") == 0) | (F.col("since") > overlap)
    flushed = run.final().filter(rest).select(
        *keys, (F.col("fires") + 1).alias("chunk_no"), (F.col("total") - F.col("since")).alias("start"),
        F.col("total").alias("end"), F.lit(True).alias("flushed"))
    return emitted.unionByName(flushed)


def chunk_members(df: DataFrame, chunks: DataFrame, keys, order: str, size: str, step=CHUNK_SAMPLES) -> DataFrame:
    """The rows each chunk covers, wholly or in part.

    A range join on buckets of ``step``: rows and chunks meet on key and
    bucket, and a pair is kept in the first bucket they share.
    """
    keys = list(keys)

    def bucket(column):
        return F.floor(column / F.lit(step))

    rows = with_running(df, keys, order, {"_hi": ("sum", F.col(size).cast("bigint"))}, top=top_of(df, order))
    rows = rows.withColumn("_lo", F.col("_hi") - F.col(size)).filter(F.col("_lo") < F.col("_hi"))
    rows = rows.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi") - 1))))
    spans = chunks.filter(F.col("start") < F.col("end")).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    pairs = rows.join(spans, [*keys, "_bucket"])
    overlapping = (F.col("_lo") < F.col("end")) & (F.col("start") < F.col("_hi"))
    once = F.col("_bucket") == bucket(F.greatest("_lo", "start"))
    return pairs.filter(overlapping & once).drop("_lo", "_hi", "_bucket")
