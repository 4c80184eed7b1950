"""Whole analyses of meetings: live fires, final summaries, replays."""

import uuid

from pyspark.sql import DataFrame, functions as F

from colloquy.fixed_values import HISTORY_FIELDS, HISTORY_ITEMS, LIST_FIELDS, NO_TRANSCRIPT, PROMPT_ISSUES, RETRY_SEGMENTS, WORDS_PER_ANALYSIS
from colloquy.functions.responses import error_result, parse_responses
from colloquy.operators.blocks import top_of
from colloquy.operators.budget import kept_phases, kept_ranges, phase_blocks
from colloquy.operators.firing import analysis_fires, empty_requests, feed_of, first_words
from colloquy.operators.novelty import suppress_repeats
from colloquy.operators.running import with_position
from colloquy.plans.contexts import (
    ISSUES_HEAD, analysis_inputs, analysis_requests, final_requests, issue_lists, summary_requests, with_parameters,
)
from colloquy.plans.scoring import score_in_order
from colloquy.session import cut_lineage

CALL = ["meeting_id", "fire_no"]


def segments_of(feed: DataFrame, top=None) -> DataFrame:
    """The segments of a feed, numbered without the control rows."""
    top = top_of(feed, "seq") if top is None else top
    heard = feed.filter(F.col("event") == "segment").select("meeting_id", "seq", "text")
    return with_position(heard, ["meeting_id"], "seq", name="_pos", top=top).select(
        "meeting_id", F.col("_pos").alias("seq"), "text")


def apply_responses(responses: DataFrame) -> DataFrame:
    """Parse live responses and drop repeated findings.

    Takes ``meeting_id, fire_no, response`` (and ``error``); returns ``result``
    and ``is_error`` per analysis. Failed analyses add nothing to the history.
    """
    failure = "error" if "error" in responses.columns else None
    # Parsed once, read three times; a filter on the outcome would otherwise be
    # pushed below the parsing and repeat it.
    parsed = cut_lineage(parse_responses(responses, failure=failure))
    lists = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f"result.{f}").alias("items")) for f in HISTORY_FIELDS])
    items = parsed.filter(~F.col("is_error")).select(*CALL, F.inline(lists))
    kept = suppress_repeats(items, ["meeting_id", "kind"], "fire_no", "items")
    wide = kept.groupBy(*CALL).agg(*[
        F.max(F.when(F.col("kind") == f, F.col("items"))).alias(f"_{f}") for f in HISTORY_FIELDS])
    out = parsed.join(wide, CALL, "left")
    result = F.col("result")
    for f in HISTORY_FIELDS:
        result = result.withField(f, F.coalesce(F.col(f"_{f}"), F.col(f"result.{f}")))
    return out.withColumn("result", result).drop(*[f"_{f}" for f in HISTORY_FIELDS])


def survivors_of(results: DataFrame) -> DataFrame:
    ok = results.filter(~F.col("is_error"))
    return ok.select(*CALL, *[F.col(f"result.{f}").alias(f) for f in HISTORY_FIELDS])


def summaries_of(scored: DataFrame) -> DataFrame:
    """Rolling summaries from their scored requests; a failed one leaves none."""
    return scored.filter(F.col("error").isNull() & F.col("response").isNotNull()).select(
        "meeting_id", F.col("fire_no").alias("summary_seq"), F.col("response").alias("text"))


class MeetingAnalysis:
    """Outcome of :func:`analyse`, as DataFrames."""

    def __init__(self, fires, results, summaries, ranges, usage):
        self.fires, self.results, self.summaries = fires, results, summaries
        self.ranges, self.usage = ranges, usage
        self.errors = None  # results of requests before the first word

    @property
    def survivors(self):
        return survivors_of(self.results)


def analyse(feed: DataFrame, scorer, threshold=WORDS_PER_ANALYSIS, controls=True, minutes=None) -> MeetingAnalysis:
    """Run every analysis of every meeting with ``scorer`` (requests -> responses).

    Where analyses fire never depends on responses, and summaries depend only
    on text, so both are whole-table jobs. A scorer that does not read the
    known issues (``reads_history = False``) is run once over everything;
    a client's requests go meeting by meeting, in order, in one job.

    ``minutes`` (``meeting_id, seq, minutes``) tells how long a meeting had
    lasted at a row of the feed; prompts say 0 without it.
    """
    top = top_of(feed, "seq")
    if controls:
        segments = cut_lineage(segments_of(feed, top))
    else:
        segments = feed.filter(F.col("event") == "segment").select("meeting_id", "seq", "text")
    fires = cut_lineage(analysis_fires(feed, threshold, controls=controls, top=top))
    if minutes is not None:
        known = minutes.select("meeting_id", "seq", F.col("minutes").cast("int"))
        fires = fires.join(known, ["meeting_id", "seq"], "left").withColumn("minutes", F.coalesce("minutes", F.lit(0)))
    scored = cut_lineage(scorer(with_parameters(summary_requests(segments, fires))))
    summaries = summaries_of(scored)
    ranges = cut_lineage(kept_ranges(summaries, top=top + 1))
    phases = cut_lineage(phase_blocks(kept_phases(ranges, top)))
    # A failed summary leaves no row, so summaries are counted by those written.
    inputs = analysis_inputs(segments, _with_written(fires, summaries), phases, top + 1)
    if getattr(scorer, "reads_history", True):
        responses, results = _in_order(inputs, scorer)
    else:
        blind = inputs.withColumn("issues", F.lit(None).cast("string"))
        responses = cut_lineage(scorer(with_parameters(analysis_requests(blind))))
        results = apply_responses(responses)
    usage = responses.select("request_id", "meeting_id", "kind", "prompt_tokens", "completion_tokens", "total_tokens")
    usage = usage.unionByName(scored.select(*usage.columns))
    run = MeetingAnalysis(fires, results, summaries, ranges, usage)
    run.errors = empty_errors(feed)
    return run


def _with_written(fires, summaries):
    written = summaries.select("meeting_id", F.col("summary_seq").alias("fire_no"), F.lit(True).alias("_ok"))
    return fires.join(written, CALL, "left").withColumn("summary_fired", F.coalesce("_ok", F.lit(False))).drop("_ok")


def _in_order(inputs: DataFrame, scorer):
    """Score the analyses of every meeting in their order, each with the survivors so far, in one job."""
    marker = f"\u0001{uuid.uuid4().hex}"
    asked = with_parameters(analysis_requests(inputs.withColumn("issues", F.lit(marker))))
    answered = cut_lineage(score_in_order(asked, scorer.make_client, HISTORY_FIELDS, LIST_FIELDS, marker, ISSUES_HEAD, PROMPT_ISSUES, HISTORY_ITEMS))
    parsed = parse_responses(answered, failure="error")
    result = F.col("result")
    for f in HISTORY_FIELDS:
        result = result.withField(f, F.coalesce(f"_{f}", F.col(f"result.{f}")))
    outcomes = cut_lineage(parsed.withColumn("result", result).drop(*[f"_{f}" for f in HISTORY_FIELDS]))
    return outcomes, outcomes


def empty_errors(feed: DataFrame) -> DataFrame:
    """The error results of on-demand requests made before any word was heard: ``meeting_id, seq, result, is_error``."""
    return empty_requests(feed, first_words(feed)).select(
        "meeting_id", "seq", error_result(NO_TRANSCRIPT).alias("result"), F.lit(True).alias("is_error"))


def final_analysis(segments: DataFrame, scorer, retry=True, **context) -> DataFrame:
    """Final analysis per meeting, with one retry on the last segments if it failed."""
    answered = cut_lineage(scorer(with_parameters(final_requests(segments, **context))))
    parsed = parse_responses(answered, live=F.lit(False), failure="error").select("meeting_id", "result", "is_error", "error")
    parsed = parsed.withColumn("retried", F.lit(False))
    if not retry:
        return parsed
    failed = parsed.filter("is_error").select("meeting_id")
    ends = segments.groupBy("meeting_id").agg(F.max("seq").alias("_last")).join(failed, "meeting_id")
    tail = segments.join(ends, "meeting_id").filter(F.col("seq") > F.col("_last") - RETRY_SEGMENTS)
    # Ten rows per failed meeting: numbered again from 0.
    tail = tail.select("meeting_id", (F.col("seq") - F.greatest(F.col("_last") - RETRY_SEGMENTS + 1, F.lit(0))).alias("seq"), "text")
    # Written once: every later action would otherwise ask the model again.
    again = cut_lineage(scorer(with_parameters(final_requests(tail))))
    again = parse_responses(again, live=F.lit(False), failure="error").select("meeting_id", "result", "is_error", "error")
    again = again.withColumn("retried", F.lit(True))
    return parsed.filter(~F.col("is_error")).unionByName(again)


def replay(segments: DataFrame, auto=False, threshold=WORDS_PER_ANALYSIS) -> DataFrame:
    """Fires of a full-history replay; without ``auto`` there are none."""
    return analysis_fires(feed_of(segments, auto), threshold, controls=False)
