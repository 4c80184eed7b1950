"""Segments of a timed signal, separated by silence."""

from pyspark.sql import DataFrame, functions as F

from colloquy.fixed_values import VOICE_PREFIX_MS, VOICE_SCORE, VOICE_SILENCE_MS
from colloquy.functions.text import epoch_micros
from colloquy.operators.running import with_running


def active_segments(df: DataFrame, keys, ts: str, score: str, threshold=VOICE_SCORE,
                    silence_ms=VOICE_SILENCE_MS, prefix_ms=VOICE_PREFIX_MS) -> DataFrame:
    """Group points scoring ``threshold`` or more while gaps stay within ``silence_ms``.

    Points in one cell of the silence's length belong together whatever else
    happens, so cells are aggregated first (map side), however many points
    they hold; only cells are ordered. Starts move back by ``prefix_ms``.
    """
    keys, gap = list(keys), silence_ms * 1000
    points = df.filter(F.col(score) >= threshold).select(
        *keys, F.col(ts).alias("_ts"), epoch_micros(df, ts).alias("_us"), F.col(score).alias("_score"))
    cell = F.expr(f"_us div {gap}")
    cells = points.groupBy(*keys, cell.alias("_cell")).agg(
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.min("_ts").alias("_first"), F.max("_ts").alias("_last"),
        F.count("*").alias("_n"), F.max("_score").alias("_top"))
    # Cells count from the first one, so that few of them make few blocks.
    low, high = points.agg(F.min(cell), F.max(cell)).first()
    cells = cells.withColumn("_cell", F.col("_cell") - F.lit(low or 0))
    top = (high or 0) - (low or 0)
    cells = with_running(cells, keys, "_cell", {"_before": ("max", "_hi")}, inclusive=False, top=top)
    opens = F.when(F.col("_before").isNull() | (F.col("_lo") - F.col("_before") > gap), 1).otherwise(0)
    cells = with_running(cells, keys, "_cell", {"segment_no": ("sum", opens.cast("bigint"))}, top=top)
    return (
        cells.groupBy(*keys, "segment_no")
        .agg((F.min("_first") - F.expr(f"interval {prefix_ms} milliseconds")).alias("start"), F.max("_last").alias("end"),
             F.sum("_n").alias("points"), F.max("_top").alias("top_score"))
    )
