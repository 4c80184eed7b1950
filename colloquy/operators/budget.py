"""Rolling summaries kept within a word budget."""

from pyspark.sql import DataFrame, Window, functions as F

from colloquy.fixed_values import SUMMARY_WORD_BUDGET
from colloquy.functions.text import n_words
from colloquy.operators.blocks import top_of
from colloquy.operators.running import with_running

MEETING = ["meeting_id"]


def kept_ranges(summaries: DataFrame, budget=SUMMARY_WORD_BUDGET, top=None, **blocks) -> DataFrame:
    """For every summary, which ones are kept right after it was written.

    Popping the oldest while the total exceeds the budget leaves the longest
    run of latest summaries within it, so a first position says it all:
    ``idx`` is the summary's own position, ``first_kept`` the oldest kept
    (``idx + 1`` when even the newest is too long), ``kept`` their number.

    The first position comes from a range frame over the words written so far,
    cut into blocks of whole budgets with the budget before each.
    """
    top = top_of(summaries, "summary_seq") if top is None else top
    sized = summaries.withColumn("n_words", n_words("text"))
    rows = with_running(sized, MEETING, "summary_seq", {
        "written": ("sum", "n_words"), "idx": ("count", None)}, top=top, **blocks)
    rows = rows.withColumn("idx", F.col("idx") - 1)
    span = 16 * max(budget, 1)
    levels = rows.groupBy("meeting_id", "written").agg(F.min("idx").alias("_idx"))
    reach = F.when(F.pmod("written", F.lit(span)) >= span - budget, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    levels = levels.withColumn("_step", F.explode(reach)).withColumn("_span", F.expr(f"written div {span}") + F.col("_step"))
    frame = Window.partitionBy("meeting_id", "_span").orderBy("written").rangeBetween(-budget, Window.currentRow)
    starts = (
        levels.withColumn("_start", F.min("_idx").over(frame)).filter(F.col("_step") == 0)
        .select("meeting_id", "written", "_start")
    )
    first = F.when(F.col("written") <= budget, F.lit(0)).otherwise(F.col("_start") + 1)
    return (
        rows.join(starts, ["meeting_id", "written"])
        .withColumn("first_kept", F.least(first, F.col("idx") + 1).cast("bigint")).drop("_start", "written")
        .withColumn("kept", F.col("idx") - F.col("first_kept") + 1)
    )


def kept_phases(ranges: DataFrame, top=None) -> DataFrame:
    """One row per kept summary with its phase number, for every state; blank summaries keep theirs."""
    own = ranges.select("meeting_id", F.col("idx").alias("_i"), F.col("text").alias("phase_text"))
    states = ranges.filter(F.col("kept") > 0).select(
        "meeting_id", "idx", "summary_seq", "first_kept", F.explode(F.sequence("first_kept", "idx")).alias("_i"))
    return states.join(own, ["meeting_id", "_i"]).select(
        "meeting_id", "idx", "summary_seq", (F.col("_i") - F.col("first_kept") + 1).alias("phase"), "phase_text")


def phase_blocks(phases: DataFrame) -> DataFrame:
    """The kept summaries of a state as one text, numbered from 1."""
    line = F.format_string("\nPhase %d:\n%s", F.col("phase"), F.col("phase_text"))
    rows = phases.groupBy("meeting_id", "idx", "summary_seq").agg(
        F.sort_array(F.collect_list(F.struct("phase", line.alias("line")))).alias("_rows"))
    return rows.select("meeting_id", "idx", "summary_seq",
                       F.array_join(F.transform("_rows", lambda r: r["line"]), "\n").alias("phases"))
