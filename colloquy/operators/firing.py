"""When a meeting is analysed: word thresholds, requests, summaries, admission."""

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.fixed_values import (
    CUSTOM_THRESHOLD_RANGE, MANUAL_THRESHOLD, MIN_WORDS_ON_DEMAND, PRESET_THRESHOLDS,
    WORDS_PER_ANALYSIS, WORDS_PER_ROLLING_SUMMARY,
)
from colloquy.functions.text import elapsed_seconds, n_words
from colloquy.operators.blocks import BITS, SUPER_BITS, top_of
from colloquy.operators.running import with_running
from colloquy.operators.trigger import Triggered, reset_trigger

MEETING = ["meeting_id"]


def feed_of(segments: DataFrame, auto=True) -> DataFrame:
    """A feed without control rows."""
    return segments.select(
        "meeting_id", "seq", F.lit("segment").alias("event"), "text",
        F.lit(auto).alias("auto"), F.lit(None).cast("int").alias("value"))


def limit_of(mode, words) -> Column:
    """Threshold of an analysis mode; manual meetings never reach theirs."""
    mode = F.col(mode) if isinstance(mode, str) else mode
    words = F.col(words) if isinstance(words, str) else F.lit(words)
    return F.when(mode == "automatic", words).otherwise(F.lit(MANUAL_THRESHOLD)).cast("int")


def is_offered_threshold(words) -> Column:
    low, high, step = CUSTOM_THRESHOLD_RANGE
    words = F.col(words) if isinstance(words, str) else F.lit(words)
    return words.isin(*PRESET_THRESHOLDS) | (words.between(low, high) & ((words - low) % step == 0))


def check_threshold(words: int) -> int:
    low, high, step = CUSTOM_THRESHOLD_RANGE
    if words not in PRESET_THRESHOLDS and not (low <= words <= high and (words - low) % step == 0):
        raise ValueError(f"threshold must be one of {PRESET_THRESHOLDS} or {low}..{high} in steps of {step}")
    return words


def trigger_segments(segments: DataFrame, threshold=WORDS_PER_ANALYSIS, lookback=0, extras=(), top=None,
                     bits=BITS, super_bits=SUPER_BITS) -> Triggered:
    """The word trigger over plain segments with one threshold."""
    top = top_of(segments, "seq") if top is None else top
    sized = segments.withColumn("_words", n_words("text"))
    return reset_trigger(sized, MEETING, "seq", "_words", threshold if threshold > 0 else F.lit(None),
                         extras=extras, lookback=lookback, top=top, bits=bits, super_bits=super_bits)


def analysis_fires(feed: DataFrame, threshold=WORDS_PER_ANALYSIS, summary_words=WORDS_PER_ROLLING_SUMMARY,
                   controls=True, top=None, bits=BITS, super_bits=SUPER_BITS) -> DataFrame:
    """All analyses of every meeting, automatic and on demand.

    ``threshold`` is a number or a column; ``set_threshold`` rows replace it
    from the next row on, and ``analyze_now`` rows fire at once. Columns:
    ``meeting_id, seq, fire_no, kind, seg_pos, since, total, summary_fired``,
    where ``seg_pos`` is the position of the last segment so far.
    """
    blocks = dict(top=top_of(feed, "seq") if top is None else top, bits=bits, super_bits=super_bits)
    base = F.lit(threshold) if isinstance(threshold, int) else threshold
    is_segment = F.col("event") == "segment"
    rows = feed.select(
        "meeting_id", "seq", "event", F.coalesce("auto", F.lit(True)).alias("auto"),
        F.when(is_segment, n_words("text")).otherwise(F.lit(0)).alias("_words"),
        F.when(F.col("event") == "set_threshold", F.col("value")).alias("_set"), base.alias("_base"))
    if controls:
        rows = with_running(rows, MEETING, "seq", {
            "_now": ("last", "_set"),
            "seg_pos": ("sum", F.when(is_segment, 1).otherwise(0).cast("bigint")),
        }, **blocks).withColumn("seg_pos", F.col("seg_pos") - 1)
    else:
        rows = rows.withColumn("_now", F.lit(None).cast("int")).withColumn("seg_pos", F.col("seq"))
    current = F.coalesce("_now", "_base")
    limit = F.when(F.col("event") == "analyze_now", 0).when(is_segment & F.col("auto") & (current > 0), current)
    fired = reset_trigger(rows, MEETING, "seq", "_words", limit, extras=["event", "seg_pos"], **blocks).fires()
    fired = fired.withColumn(
        "kind", F.when(F.col("event") == "analyze_now", "comprehensive").otherwise("incremental"))
    return with_summaries(fired.drop("event"), summary_words, **blocks)


def with_summaries(fires: DataFrame, summary_words=WORDS_PER_ROLLING_SUMMARY, top=None, bits=BITS,
                   super_bits=SUPER_BITS) -> DataFrame:
    """Mark the analyses that also write a rolling summary.

    The summary threshold is looked at only when an analysis runs, so it is
    the same trigger again, one row per analysis.
    """
    extras = [c for c in fires.columns if c not in MEETING]
    rows = fires.withColumn("_idx", F.col("fire_no") - 1)
    done = reset_trigger(rows, MEETING, "_idx", "since", summary_words, extras=extras, top=top, bits=bits,
                         super_bits=super_bits).rows()
    return done.drop("_idx").withColumnRenamed("fired", "summary_fired")


def empty_requests(feed: DataFrame, first_word: DataFrame) -> DataFrame:
    """On-demand requests made before any word was heard: error, no state change."""
    asked = feed.filter(F.col("event") == "analyze_now").select("meeting_id", "seq")
    joined = asked.join(first_word, "meeting_id", "left")
    return joined.filter(F.col("first_seq").isNull() | (F.col("seq") < F.col("first_seq"))).drop("first_seq")


def first_words(feed: DataFrame) -> DataFrame:
    heard = feed.filter((F.col("event") == "segment") & (n_words("text") > 0))
    return heard.groupBy("meeting_id").agg(F.min("seq").alias("first_seq"))


def progress(final: DataFrame, threshold: int) -> DataFrame:
    """Words left until the next automatic analysis; null once it is due."""
    left = F.lit(threshold) - F.col("since")
    shown = final.withColumn("words_left", F.when(left > 0, left).cast("bigint"))
    return shown.withColumn("progress", 1 - F.col("words_left") / F.lit(threshold))


def on_demand_stats(requests: DataFrame, end) -> DataFrame:
    """Number of on-demand analyses and seconds since the last, from timed requests."""
    end = F.col(end) if isinstance(end, str) else end
    asked = F.col("event") == "analyze_now"
    return requests.groupBy("meeting_id").agg(
        F.count_if(asked).alias("on_demand_count"),
        elapsed_seconds(F.max(F.when(asked, F.col("fire_ts"))), F.max(end)).cast("bigint").alias("seconds_since"))


def admission(meetings: DataFrame) -> DataFrame:
    """Why an on-demand or final analysis may not run (null: it may).

    Takes ``has_session, segments, words`` per meeting.
    """
    return (
        meetings
        .withColumn("on_demand_refusal", F.when(~F.col("has_session"), "no session")
                    .when(F.coalesce("segments", F.lit(0)) == 0, "no transcript")
                    .when(F.col("words") < MIN_WORDS_ON_DEMAND, "too few words"))
        .withColumn("final_refusal", F.when(F.coalesce("segments", F.lit(0)) == 0, "no transcript"))
    )
