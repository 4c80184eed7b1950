"""Silence-gap segments of a live signal."""

from pyspark.sql import DataFrame, functions as F

from colloquy.fixed_values import VOICE_PREFIX_MS, VOICE_SCORE, VOICE_SILENCE_MS


def live_segments(points: DataFrame, keys, ts: str, score: str, threshold=VOICE_SCORE, silence_ms=VOICE_SILENCE_MS,
                  prefix_ms=VOICE_PREFIX_MS, lateness="1 minute") -> DataFrame:
    """Segments of active points, out once the watermark has passed their silence."""
    active = points.filter(F.col(score) >= threshold).withWatermark(ts, lateness)
    silence = F.expr(f"interval {silence_ms} milliseconds")
    grouped = active.groupBy(*keys, F.session_window(ts, f"{silence_ms} milliseconds")).agg(
        F.count("*").alias("points"), F.max(score).alias("top_score"))
    return grouped.select(
        *keys, (F.col("session_window.start") - F.expr(f"interval {prefix_ms} milliseconds")).alias("start"),
        (F.col("session_window.end") - silence).alias("end"), "points", "top_score")
