"""What a model gets to read: bounded contexts for every kind of request."""

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.fixed_values import (
    COMPREHENSIVE_TAIL_WORDS, FINAL_TAIL_WORDS, PROMPT_ISSUES, RECENT_SEGMENTS, SUMMARY_SEGMENTS,
)
from colloquy.operators.history import meeting_tails, recent_at, tail_at, with_totals
from colloquy.operators.running import with_running
from colloquy.plans.prompts import request_kinds

ISSUES_HEAD = "Known issues (do not repeat):"
PHASES_HEAD = "Summaries so far:"
RECENT_HEAD = "Recent discussion:"


def _facts(mode: Column) -> Column:
    return F.format_string("Minutes: %d\nWords: %d\nAnalyses so far: %d\nMode: %s",
                           F.col("minutes"), F.col("total"), F.col("fire_no") - 1, mode)


def issue_lists(survivors: DataFrame, fires: DataFrame, n=PROMPT_ISSUES, top=None) -> DataFrame:
    """The last ``n`` issues kept before each analysis, as lines.

    ``survivors`` holds the kept ``potential_issues`` of every analysis. The
    items are numbered through the meeting; an analysis looks back from the
    number its own items begin with.
    """
    sized = fires.select("meeting_id", "fire_no").join(
        survivors.select("meeting_id", "fire_no", F.col("potential_issues").alias("_items")), ["meeting_id", "fire_no"], "left")
    sized = with_running(sized.withColumn("_n", F.greatest(F.size("_items"), F.lit(0)).cast("bigint")),
                         ["meeting_id"], "fire_no", {"_before": ("sum", "_n")}, inclusive=False, top=top)
    sized = sized.withColumn("_before", F.coalesce("_before", F.lit(0)))
    items = sized.select("meeting_id", "_before", F.posexplode("_items").alias("_o", "text")).select(
        "meeting_id", (F.col("_before") + F.col("_o")).alias("seq"), F.concat(F.lit("- "), "text").alias("text"))
    points = sized.filter(F.col("_before") > 0).select("meeting_id", "fire_no", (F.col("_before") - 1).alias("seg_pos"))
    return recent_at(items, points, n, name="issues", sep="\n").drop("seg_pos")


def phases_at(fires: DataFrame, phases: DataFrame, top=None) -> DataFrame:
    """Number of summaries written up to each analysis, and the text of those kept.

    ``phases`` is keyed by ``idx``, the position of the newest summary.
    """
    counted = with_running(
        fires, ["meeting_id"], "fire_no", {"_written": ("sum", F.col("summary_fired").cast("bigint"))}, top=top)
    return counted.withColumn("idx", F.col("_written") - 1).drop("_written").join(
        phases.select("meeting_id", "idx", "phases"), ["meeting_id", "idx"], "left").drop("idx")


def _section(head, body) -> Column:
    return F.when(F.col(body).isNotNull(), F.concat(F.lit(head + "\n"), F.col(body)))


def incremental_context(issues="issues", phases="phases", recent="recent") -> Column:
    return F.concat_ws("\n\n", _facts(F.lit("automatic")), _section(ISSUES_HEAD, issues),
                       _section(PHASES_HEAD, phases), _section(RECENT_HEAD, recent))


def comprehensive_context(n=COMPREHENSIVE_TAIL_WORDS, issues="issues", phases="phases", tail="tail") -> Column:
    head = F.when(F.col("total") > n, F.format_string(f"Discussion, last {n} of %d words:", F.col("total"))) \
        .otherwise(F.format_string("Whole discussion, %d words:", F.col("total")))
    return F.concat_ws("\n\n", _facts(F.lit("on demand")), _section(ISSUES_HEAD, issues),
                       _section(PHASES_HEAD, phases), F.concat_ws("\n", head, F.col(tail)))


def final_context(n=FINAL_TAIL_WORDS, phases="phases", tail="tail") -> Column:
    facts = F.format_string("Meeting over\nMinutes: %d\nWords: %d\nAnalyses: %d",
                            F.col("minutes"), F.col("total"), F.col("analyses"))
    head = F.when(F.col("total") > n, F.lit(f"Transcript, last {n} words:")).otherwise(F.lit("Whole transcript:"))
    return F.concat_ws("\n\n", facts, _section(PHASES_HEAD, phases), F.concat_ws("\n", head, F.col(tail)))


def summary_requests(segments: DataFrame, fires: DataFrame) -> DataFrame:
    """The last five segments at each summary, whenever the previous one was."""
    points = fires.filter("summary_fired").select("meeting_id", "fire_no", "seg_pos")
    return recent_at(segments, points, SUMMARY_SEGMENTS, name="user_prompt").drop("seg_pos").withColumn(
        "kind", F.lit("summary"))


def analysis_inputs(segments: DataFrame, fires: DataFrame, phases: DataFrame, top=None) -> DataFrame:
    """Everything an analysis reads but the issues found before it."""
    fires = fires if "minutes" in fires.columns else fires.withColumn("minutes", F.lit(0))
    with_phases = phases_at(fires, phases, top)
    incremental = with_phases.filter(F.col("kind") == "incremental")
    comprehensive = with_phases.filter(F.col("kind") == "comprehensive")
    nothing = F.lit(None).cast("string")
    recent = recent_at(segments, incremental, RECENT_SEGMENTS, name="recent").withColumn("tail", nothing)
    tails = tail_at(with_totals(segments, top), comprehensive, COMPREHENSIVE_TAIL_WORDS).withColumn("recent", nothing)
    return recent.unionByName(tails)


def analysis_requests(inputs: DataFrame) -> DataFrame:
    """User prompts of analyses; ``inputs`` also holds ``issues``."""
    prompt = F.when(F.col("kind") == "incremental", incremental_context()).otherwise(comprehensive_context())
    return inputs.select("meeting_id", "fire_no", "kind", prompt.alias("user_prompt"))


def final_requests(segments: DataFrame, analyses=None, phases=None, minutes=None, n=FINAL_TAIL_WORDS) -> DataFrame:
    """One final request per meeting.

    ``analyses`` (per meeting) and ``phases`` (per meeting) are left out when
    the meeting was replayed without automatic analyses.
    """
    ends = meeting_tails(segments, n)
    if minutes is not None:
        ends = ends.join(minutes, "meeting_id", "left")
    if analyses is not None:
        ends = ends.join(analyses, "meeting_id", "left")
    if phases is not None:
        ends = ends.join(phases, "meeting_id", "left")
    for name, empty in (("minutes", F.lit(0)), ("analyses", F.lit(0)), ("phases", F.lit(None).cast("string"))):
        ends = ends.withColumn(name, F.coalesce(name, empty) if name in ends.columns else empty)
    return ends.select(
        "meeting_id", F.lit(0).cast("bigint").alias("fire_no"), F.lit("final").alias("kind"),
        final_context(n).alias("user_prompt"))


def with_parameters(requests: DataFrame) -> DataFrame:
    """Add system prompt, temperature, token limit and JSON mode by kind; an unknown kind has none, and scorers answer it with an error."""
    kinds = F.broadcast(request_kinds(requests.sparkSession))  # four fixed rows
    named = requests.withColumn("request_id", F.concat_ws("-", "meeting_id", "kind", "fire_no"))
    return named.join(kinds, "kind", "left").select(
        "request_id", "meeting_id", "fire_no", "kind", "system_prompt", "user_prompt", "temperature", "max_tokens",
        "json_mode")
