"""Bounded looks back from chosen positions: last segments, last words, transcripts."""

from pyspark.sql import DataFrame, functions as F

from colloquy.functions.text import n_words, words
from colloquy.operators.blocks import BITS, BLOCK, block_of, top_of, with_halo
from colloquy.operators.running import with_running

MEETING = ["meeting_id"]
PART_BITS = 12  # segments per transcript part: 4096


def recent_at(segments: DataFrame, points: DataFrame, n: int, name="recent", sep=" ", bits=BITS) -> DataFrame:
    """Join the last ``n`` segments up to ``seg_pos`` to every point.

    Segments are cut into blocks with the ``n - 1`` positions before them, so
    a point finds all it needs in its own block and takes it by index. That
    needs positions without gaps: others are an error here, see
    ``running.with_position``.
    """
    rows = with_halo(segments.select("meeting_id", "seq", "text"), "seq", n - 1, bits)
    blocks = rows.groupBy("meeting_id", BLOCK).agg(
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_rows"))
    first, held = F.col("_rows")[0]["seq"], F.size("_rows")
    due = F.greatest(F.shiftleft(F.col(BLOCK), bits) - (n - 1), F.lit(0))
    dense = (first == due) & (F.element_at("_rows", -1)["seq"] - first + 1 == held)
    fault = F.raise_error(F.format_string("the positions of meeting %s have gaps: number them by running.with_position", F.col("meeting_id").cast("string")))
    blocks = blocks.withColumn("_rows", F.when(dense, F.col("_rows")).otherwise(fault.cast(blocks.schema["_rows"].dataType)))
    at = points.withColumn(BLOCK, block_of("seg_pos", bits))
    end = F.col("seg_pos") - first + 1
    taken = F.slice("_rows", F.greatest(end - n + 1, F.lit(1)).cast("int"), F.least(end, F.lit(n)).cast("int"))
    joined = at.join(blocks, ["meeting_id", BLOCK])
    return joined.withColumn(name, F.concat_ws(sep, F.transform(taken, lambda s: s["text"]))).drop(BLOCK, "_rows")


def with_totals(segments: DataFrame, top=None, **blocks) -> DataFrame:
    """Segments with the words heard so far."""
    top = top_of(segments, "seq") if top is None else top
    sized = segments.withColumn("_n", n_words("text"))
    return with_running(sized, MEETING, "seq", {"total": ("sum", "_n")}, top=top, **blocks).drop("_n")


def tail_at(segments: DataFrame, points: DataFrame, n: int, name="tail", block_words=4096) -> DataFrame:
    """Join the last ``n`` words heard at every point, or all if there are not more.

    ``segments`` come from :func:`with_totals`; points hold ``seg_pos`` and
    ``total``. Blocks are cut by words, not rows, each with the last ``n``
    words before it.
    """
    size = max(block_words, 2 * n)
    own = F.expr(f"total div {size}")
    repeat = F.pmod(F.col("total"), F.lit(size)) > size - n
    steps = F.when(repeat, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = segments.select("meeting_id", "seq", "text", "total", F.explode(steps).alias("_step"))
    blocks = rows.groupBy("meeting_id", (own + F.col("_step")).alias(BLOCK)).agg(
        F.sort_array(F.collect_list(F.struct("seq", "total", "text"))).alias("_rows"))
    at = points.withColumn(BLOCK, own).alias("p")
    joined = at.join(blocks, ["meeting_id", BLOCK])
    needed = F.filter("_rows", lambda s: (s["seq"] <= F.col("seg_pos")) & (
        (F.col("total") <= n) | (s["total"] > F.col("total") - n)))
    text = F.array_join(F.transform(needed, lambda s: s["text"]), " ")
    cut = F.slice(words(text), -n, n)
    return joined.withColumn(
        name, F.when(F.col("total") > n, F.array_join(cut, " ")).otherwise(text)).drop(BLOCK, "_rows")


def meeting_tails(segments: DataFrame, n: int, name="tail", top=None) -> DataFrame:
    """Per meeting its last position, its words, and the last ``n`` of them.

    Where no meeting is longer than a block this is one aggregation; longer
    ones keep to bounded blocks, see :func:`tail_at`.
    """
    top = top_of(segments, "seq") if top is None else top
    if top >> BITS:
        totals = with_totals(segments.select("meeting_id", "seq", "text"), top)
        return tail_at(totals, meeting_ends(totals), n, name)
    whole = segments.groupBy("meeting_id").agg(
        F.max("seq").alias("seg_pos"), F.sum(n_words("text")).alias("total"),
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_rows"))
    text = F.array_join(F.transform("_rows", lambda s: s["text"]), " ")
    cut = F.array_join(F.slice(words(text), -n, n), " ")
    return whole.withColumn(name, F.when(F.col("total") > n, cut).otherwise(text)).drop("_rows")


def meeting_ends(totals: DataFrame) -> DataFrame:
    """The last position of every meeting and its words, as points."""
    return totals.groupBy("meeting_id").agg(F.max("seq").alias("seg_pos"), F.max("total").alias("total"))


def transcript(segments: DataFrame, keys=("meeting_id",), order="seq", bits=PART_BITS) -> DataFrame:
    """Full text per key, in parts of ``2**bits`` positions.

    Joining the parts in order with a space gives the whole transcript; a
    meeting up to that length is one part.
    """
    parts = segments.groupBy(*keys, block_of(order, bits).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), "text"))).alias("_rows"))
    return parts.select(*keys, "part", F.array_join(F.transform("_rows", lambda s: s["text"]), " ").alias("text"))
