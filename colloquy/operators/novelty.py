"""Suppression of findings that repeat recent ones."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.fixed_values import HISTORY_ITEMS
from colloquy.operators.blocks import BLOCK, SUPER_BITS, block_of, each
from colloquy.operators.running import with_running
from colloquy.session import cut_lineage

NOVELTY_BITS = 8  # analyses per block: 256
ROUNDS = 2        # repairs of all blocks at once, before open keys are walked in order


def _bind(value, body) -> Column:
    """Give an expression a name inside a lambda, so that it runs once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _last(items, n) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def _sift(rows, history, window, emit=True) -> Column:
    """Run through sorted rows; state is the lower-cased last survivors."""
    begin = [history.alias("seen")]
    if emit:
        begin.append(F.array().cast("array<array<string>>").alias("kept"))

    def step(acc, row):
        pairs = F.transform(row["items"], lambda i: F.struct(i.alias("text"), F.lower(i).alias("low")))
        fresh = F.filter(pairs, lambda i: ~F.exists(
            acc["seen"], lambda p: F.contains(p, i["low"]) | F.contains(i["low"], p)))
        return _bind(fresh, lambda f: F.struct(
            _last(F.concat(acc["seen"], F.transform(f, lambda i: i["low"])), window).alias("seen"),
            *([F.concat(acc["kept"], F.array(F.transform(f, lambda i: i["text"]))).alias("kept")] if emit else [])))

    return F.aggregate(rows, F.struct(*begin), step)


def suppress_repeats(df: DataFrame, keys, order: str, items: str, window=HISTORY_ITEMS,
                     bits=NOVELTY_BITS, super_bits=SUPER_BITS) -> DataFrame:
    """Drop items that contain, or are contained in, one of the last survivors.

    ``items`` is the list of one analysis, compared case-insensitively with the
    last ``window`` items kept in earlier analyses of the same key; items of
    one list are not compared with each other.

    What survives depends on all earlier outcomes, yet a block only needs the
    survivors at its start. All blocks first run from a guess; a block whose
    true start differs is run again, a fixed number of times. What is then
    still open are long chains of repeats: their keys' blocks are walked in
    order, streamed, with the last survivors as the only state. So the number
    of jobs does not grow with the data.
    """
    keys = list(keys)
    rows = df.select(*keys, order, items)
    blocks = (
        rows.withColumn(BLOCK, block_of(order, bits)).groupBy(*keys, BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col(items).alias("items")))).alias("_rows"))
    )
    nothing = F.array().cast("array<string>")
    low, high = rows.agg(F.min(block_of(order, bits)), F.max(block_of(order, bits))).first()
    if low == high:
        sifted = blocks.withColumn("_run", _sift(F.col("_rows"), nothing, window))
    else:
        blocks = cut_lineage(blocks)
        starts = _true_starts(blocks, keys, nothing, window, high, super_bits)
        sifted = blocks.join(starts, [*keys, BLOCK], "left").withColumn(
            "_run", _sift(F.col("_rows"), F.coalesce("_start", nothing), window))
    pairs = F.arrays_zip(F.col("_rows.order").alias("order"), F.col("_run.kept").alias("kept"))
    return each(sifted, "_p", pairs).select(
        *keys, F.col("_p.order").alias(order), F.col("_p.kept").alias(items))


def _true_starts(blocks, keys, nothing, window, top, super_bits) -> DataFrame:
    at = [*keys, "_no"]
    named = blocks.withColumnRenamed(BLOCK, "_no")
    # A block without items changes nothing: its end is null, and a look back goes on to the block before.
    has_items = F.exists("_rows", lambda r: F.size(r["items"]) > 0)

    def end(start):
        return F.when(has_items, _sift(F.col("_rows"), start, window, emit=False)["seen"]).alias("_end")

    known = cut_lineage(named.select(*at, nothing.alias("_start"), end(nothing), has_items.alias("_full")))
    for _ in range(ROUNDS):
        entered = with_running(known, keys, "_no", {"_in": ("last", "_end")}, inclusive=False, top=top, super_bits=super_bits)
        stale = entered.filter(F.col("_full") & (F.coalesce("_in", nothing) != F.col("_start")))
        redone = named.join(stale.select(*at, "_in"), at).select(*at, F.col("_in").alias("_start"), end(F.col("_in")), F.lit(True).alias("_full"))
        redone = cut_lineage(redone)
        if redone.isEmpty():
            return known.withColumnRenamed("_no", BLOCK).select(*keys, BLOCK, "_start")
        kept = known.join(redone.select(*at), at, "left_anti")
        known = cut_lineage(kept.unionByName(redone))
    open_keys = redone.select(*keys).distinct()
    walked = _walk(named.join(open_keys, keys, "left_semi"), keys, window)
    settled = known.select(*at, "_start").join(open_keys, keys, "left_anti")
    return settled.unionByName(walked).withColumnRenamed("_no", BLOCK)


def _walk(named: DataFrame, keys, window) -> DataFrame:
    """The survivors at the start of every block, key by key in order."""
    rows = named.select(*keys, "_no", F.transform("_rows", lambda r: F.transform(r["items"], F.lower)).alias("_lows"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_lows"], T.StructField("_start", T.ArrayType(T.StringType()))])
    n = len(keys)

    def run(batches):
        import pyarrow as pa

        here, seen = None, []
        for batch in batches:
            starts = []
            for *place, lists in zip(*(c.to_pylist() for c in batch.columns)):
                if place[:n] != here:
                    here, seen = place[:n], []
                starts.append(seen)
                for lows in lists:
                    fresh = [low for low in lows or [] if low is not None and not any(low in s or s in low for s in seen)]
                    seen = (seen + fresh)[-window:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(starts, pa.list_(pa.string()))], names=schema.names)

    return cut_lineage(rows.repartition(*keys).sortWithinPartitions(*keys, "_no").mapInArrow(run, schema))
