"""Meeting metrics, token accounting and display statistics.

Everything here is a plain aggregation with map-side partials, so a meeting
with a third of all rows costs no more than any other.
"""

from pyspark.sql import DataFrame, functions as F

from colloquy.fixed_values import PRICE_PER_1K_TOKENS
from colloquy.functions.text import elapsed_minutes, m_s, n_words

MEETING = ["meeting_id"]


def recording_stats(segments: DataFrame) -> DataFrame:
    """Segments, words and characters per meeting.

    ``characters`` counts one separator after every segment,
    ``joined_characters`` only those between segments.
    """
    return segments.groupBy(*MEETING).agg(
        F.count("*").alias("segments"), F.sum(n_words("text")).alias("words"),
        (F.sum(F.length("text")) + F.count("*")).alias("characters"),
        (F.sum(F.length("text")) + F.count("*") - 1).alias("joined_characters"))


def with_session(rows: DataFrame, sessions: DataFrame, end) -> DataFrame:
    """Attach each meeting's current session; no start time means no duration.

    No broadcast hint: the session table grows with the meetings, so Spark
    decides by its size. ``rows`` should be one row per meeting.
    """
    current = current_sessions(sessions, by="meeting_id")
    joined = rows.join(current.drop("session_id"), "meeting_id", "left")
    minutes = F.coalesce(elapsed_minutes(F.col("start_time"), end), F.lit(0)).cast("bigint")
    return joined.withColumn("duration_minutes", minutes)


def current_sessions(sessions: DataFrame, by="session_id") -> DataFrame:
    """The latest row per session or per meeting."""
    others = [c for c in sessions.columns if c != by]
    return sessions.groupBy(by).agg(F.max_by(F.struct(*others), F.struct("start_time", "session_id")).alias("_s")) \
        .select(by, *[F.col(f"_s.{c}").alias(c) for c in others])


def meeting_stats(recording: DataFrame, analyses: DataFrame, survivors: DataFrame, summaries_kept: DataFrame) -> DataFrame:
    """The seven figures of a meeting, zero where nothing happened.

    ``analyses`` has one row per analysis that ran (failed ones count),
    ``survivors`` per analysis the kept items of ``potential_issues`` and
    ``recommendations``, ``summaries_kept`` the summaries still kept.
    """
    performed = analyses.groupBy(*MEETING).agg(F.count("*").alias("analyses_performed"))
    found = survivors.groupBy(*MEETING).agg(
        F.sum(F.size("potential_issues")).alias("issues_identified"),
        F.sum(F.size("recommendations")).alias("recommendations_given"))
    kept = summaries_kept.groupBy(*MEETING).agg(F.max_by("kept", "idx").alias("summary_count"))
    out = recording.join(performed, "meeting_id", "left").join(found, "meeting_id", "left").join(kept, "meeting_id", "left")
    return out.select(
        "meeting_id", *(["duration_minutes"] if "duration_minutes" in recording.columns else []),
        F.col("words").alias("word_count"), F.col("segments").alias("transcript_segments"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (
            "summary_count", "issues_identified", "recommendations_given", "analyses_performed")])


def terminal_stats(recording: DataFrame, seconds="duration_seconds") -> DataFrame:
    return recording.select("meeting_id", m_s(seconds).alias("duration"), "segments", "words", "characters")


def panel_stats(stats: DataFrame, form=5) -> DataFrame:
    """The five- or six-figure panel; the latter shows summaries and characters."""
    common = ["meeting_id", "duration_minutes", F.col("word_count").alias("words"), F.col("transcript_segments").alias("segments")]
    if form == 5:
        done = F.col("analyses_performed").cast("string")
        if "analysis_mode" in stats.columns:
            done = F.coalesce(done, F.when(F.col("analysis_mode") == "manual", F.col("on_demand_count").cast("string")).otherwise("Auto"))
        return stats.select(*common, F.col("issues_identified").alias("issues"), done.alias("analyses"))
    return stats.select(*common, F.col("joined_characters").alias("characters"),
                        F.col("summary_count").alias("summaries"), F.col("issues_identified").alias("issues"))


def token_totals(usage: DataFrame, price=PRICE_PER_1K_TOKENS, by=("meeting_id", "kind")) -> DataFrame:
    """Tokens and cost per call kind, per meeting and in all (nulls mark totals)."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    totals = usage.rollup(*by).agg(F.count("*").alias("calls"), *sums)
    return totals.withColumn("cost", F.col("total_tokens") / 1000 * F.lit(price))


def event_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("type").agg(F.count("*").alias("events"))
