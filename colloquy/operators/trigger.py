"""Thresholds that reset when they fire.

A counter grows with every row; when it reaches the row's limit the row fires
and the counter starts again. Where it fires depends on every earlier firing,
so the rows of a key form one chain. The chain is cut into blocks: for each
block we work out how its end state follows from *any* start state (a short
step function, see :func:`block_effect`), chain these small functions to get
every block's true start, and only then run through the rows. No task ever
sees more than one block of rows or one super-block of step functions.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.operators.blocks import BITS, BLOCK, SUPER, SUPER_BITS, each, levels_for, with_halo

NEVER = (1 << 62)

_EFFECT = T.StructType([
    # Start states at or above ``at`` (largest first) end in ``left`` after
    # ``fires`` firings; lower ones do not fire and just grow by ``total``.
    T.StructField("at", T.ArrayType(T.LongType())),
    T.StructField("left", T.ArrayType(T.LongType())),
    T.StructField("fires", T.ArrayType(T.LongType())),
    T.StructField("total", T.LongType()),
])


def block_effect(sizes, limits, reset):
    """The step function of one block, see ``_EFFECT``."""
    sizes = np.asarray(sizes, dtype=np.int64)
    grown = np.cumsum(sizes)
    need = np.asarray(limits, dtype=np.int64) - grown
    falling = bool(np.all(need[1:] <= need[:-1]))
    ends = {}

    def following(p):
        level = reset - grown[p]
        if falling:
            q = max(int(np.searchsorted(-need, -level, side="left")), p + 1)
            return q if q < len(need) else None
        hits = np.flatnonzero(need[p + 1:] <= level)
        return p + 1 + int(hits[0]) if len(hits) else None

    def end_after(p):
        path = []
        while p is not None and p not in ends:
            path.append(p)
            p = following(p)
        left, fires = ends[p] if p is not None else (None, 0)
        for q in reversed(path):
            left = int(reset + grown[-1] - grown[q]) if left is None else left
            fires += 1
            ends[q] = (left, fires)
        return left, fires

    steps = []
    lowest = None
    for p in np.flatnonzero(need == np.minimum.accumulate(need)):
        at = int(max(need[p], 0))
        if at >= NEVER // 2 or (lowest is not None and at >= lowest):
            continue
        steps.append((at, *end_after(int(p))))
        lowest = at
        if at == 0:
            break
    return _merge(steps), int(grown[-1]) if len(grown) else 0


def _merge(steps):
    """Drop steps that lead to the same end as the next lower one."""
    return [s for i, s in enumerate(steps)
            if i + 1 == len(steps) or steps[i + 1][1:] != s[1:]]


def _apply(steps, total, state):
    for at, left, fires in steps:
        if state >= at:
            return left, fires
    return state + total, 0


def chain_effects(first, second):
    """The step function of two neighbouring stretches."""
    steps1, total1 = first
    steps2, total2 = second
    out = []
    for at, left, fires in steps1:
        end, more = _apply(steps2, total2, left)
        out.append((at, end, fires + more))
    lowest = steps1[-1][0] if steps1 else None
    for at, left, fires in steps2:
        at = max(at - total1, 0)
        if lowest is None or at < lowest:
            out.append((at, left, fires))
            lowest = at
    return _merge(out), total1 + total2


def _frame(keys_frame, effects):
    out = keys_frame.copy()
    for i, name in enumerate(("at", "left", "fires")):
        out[name] = [[s[i] for s in steps] for steps, _ in effects]
    out["total"] = [total for _, total in effects]
    return out


def _schema(df, columns):
    return T.StructType([df.schema[c] for c in columns] + list(_EFFECT.fields))


def _start_states(blocks: DataFrame, keys, start, reset, levels, super_bits) -> DataFrame:
    """State, grown total and firings at the start of every block but the first."""
    names = [*keys, BLOCK]
    # The first block starts from a known state: a constant, worked out
    # JVM-side, so that short keys cost Python next to nothing.
    later = F.col(BLOCK) > 0
    end = F.when(~later, _fold(F.col("_rows"), F.lit(start), F.lit(0), F.lit(0), reset, emit=False))
    inputs = blocks.select(
        *names, end.alias("_end"),
        F.when(later, F.transform("_rows", lambda x: x["size"])).alias("_sizes"),
        F.when(later, F.transform("_rows", lambda x: x["limit"])).alias("_limits"),
    ).select(*names, "_end.left", "_end.fires", "_end.total", "_sizes", "_limits")

    def effects(batches):
        for pdf in batches:
            found = [
                ([(0, int(left), int(fires))], int(total)) if sizes is None else block_effect(sizes, limits, reset)
                for left, fires, total, sizes, limits in zip(*(pdf[c] for c in ("left", "fires", "total", "_sizes", "_limits")))]
            yield _frame(pdf[names], found)

    per_block = inputs.mapInPandas(effects, _schema(blocks, names))
    packed = F.struct(F.col(BLOCK).alias("no"), "at", "left", "fires", "total")
    supers = (
        per_block.withColumn(SUPER, F.shiftright(BLOCK, super_bits) if levels == 2 else F.lit(0).cast("bigint"))
        .groupBy(*keys, SUPER).agg(F.sort_array(F.collect_list(packed)).alias("_parts"))
    )
    if levels == 2:
        supers = supers.join(_super_starts(supers, keys, start, super_bits), [*keys, SUPER], "left")
        known = [F.coalesce(c, F.lit(v)) for c, v in (("state", start), ("grown", 0), ("fired", 0))]
    else:
        known = [F.lit(start), F.lit(0), F.lit(0)]
    return _unpack(each(supers, "_s", _walk(F.col("_parts"), *known)), keys, BLOCK)


def _unpack(walked, keys, name):
    return walked.select(*keys, F.col("_s.no").alias(name), "_s.state", "_s.grown", "_s.fired").filter(F.col(name) > 0)


def _super_starts(supers: DataFrame, keys, start, super_bits) -> DataFrame:
    """The same at the start of every super-block but the first."""
    def chained(batches):
        for pdf in batches:
            found = []
            for parts in pdf["_parts"]:
                effect = ([], 0)
                for part in parts:
                    effect = chain_effects(effect, (list(zip(part["at"], part["left"], part["fires"])), part["total"]))
                found.append(effect)
            yield _frame(pdf[[*keys, SUPER]], found)

    # Only keys longer than a super-block reach this level.
    last = F.element_at("_parts", -1)["no"]
    full = supers.filter((F.col(SUPER) > 0) | (F.pmod(last, F.lit(1 << super_bits)) == (1 << super_bits) - 1))
    tops = (
        full.mapInPandas(chained, _schema(supers, [*keys, SUPER])).groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(SUPER).alias("no"), "at", "left", "fires", "total"))).alias("_parts"))
    )
    return _unpack(each(tops, "_s", _walk(F.col("_parts"), F.lit(start), F.lit(0), F.lit(0))), keys, SUPER)


def _walk(parts, state, grown, fired) -> Column:
    """Start states of a sorted list of step functions, from the first one's."""
    def longs(*cols):
        return [c.cast("bigint") for c in cols]

    state, grown, fired = longs(state, grown, fired)
    row = "array<struct<no:bigint,state:bigint,grown:bigint,fired:bigint>>"
    begin = F.struct(state.alias("state"), grown.alias("grown"), fired.alias("fired"),
                     F.array().cast(row).alias("seen"))

    def step(acc, part):
        steps = F.arrays_zip(part["at"], part["left"], part["fires"])
        hit = F.get(F.filter(steps, lambda s: s["at"] <= acc["state"]), F.lit(0))
        seen = F.struct(part["no"].alias("no"), acc["state"].alias("state"),
                        acc["grown"].alias("grown"), acc["fired"].alias("fired"))
        return F.struct(
            F.coalesce(hit["left"], acc["state"] + part["total"]).alias("state"),
            (acc["grown"] + part["total"]).alias("grown"),
            (acc["fired"] + F.coalesce(hit["fires"], F.lit(0))).alias("fired"),
            F.concat(acc["seen"], F.array(seen)).alias("seen"))

    return F.aggregate(parts, begin, step)["seen"]


def _fold(rows, state, grown, fired, reset, emit=True) -> Column:
    """Run through the sorted rows of a block from a known start state."""
    state, grown, fired = [c.cast("bigint") for c in (state, grown, fired)]
    row = "array<struct<at:int,fire_no:bigint,since:bigint,total:bigint>>"
    fields = [state.alias("left"), grown.alias("total"), fired.alias("fires")]
    if emit:
        fields += [F.lit(0).alias("at"), F.array().cast(row).alias("hits")]

    def step(acc, x):
        since = acc["left"] + x["size"]
        total = acc["total"] + x["size"]
        hit = (since >= x["limit"]) & ((x["limit"] > 0) | (total > 0))
        out = [
            F.when(hit, F.lit(reset).cast("bigint")).otherwise(since).alias("left"),
            total.alias("total"),
            F.when(hit, acc["fires"] + 1).otherwise(acc["fires"]).alias("fires"),
        ]
        if emit:
            found = F.struct((acc["at"] + 1).alias("at"), (acc["fires"] + 1).alias("fire_no"),
                             since.alias("since"), total.alias("total"))
            out += [(acc["at"] + 1).alias("at"),
                    F.when(hit, F.concat(acc["hits"], F.array(found))).otherwise(acc["hits"]).alias("hits")]
        return F.struct(*out)

    return F.aggregate(rows, F.struct(*fields), step)


class Triggered:
    """Result of :func:`reset_trigger`; each view is a lazy DataFrame."""

    def __init__(self, blocks, keys, order, extras, lookback):
        self._blocks, self._keys, self._order = blocks, list(keys), order
        self._extras, self._lookback = list(extras), lookback

    def fires(self, last: int = 1) -> DataFrame:
        """One row per firing, its columns taken from the firing row.

        With ``last`` above 1, ``recent`` holds the extras of the last rows up
        to the firing row, oldest first.
        """
        if last - 1 > self._lookback:
            raise ValueError("ask reset_trigger for a longer lookback")
        hits = each(self._blocks, "_hit", F.transform("_run.hits", lambda h: F.struct(
            h.alias("h"),
            F.slice(F.col("_rows"), F.greatest(h["at"] - last + 1, F.lit(1)), F.least(h["at"], F.lit(last))).alias("recent"))))
        own = F.element_at("_hit.recent", -1)
        return hits.select(
            *self._keys, own["order"].alias(self._order),
            *[F.col(f"_hit.h.{n}").alias(n) for n in ("fire_no", "since", "total")],
            *[own[e].alias(e) for e in self._extras],
            *([F.col("_hit.recent").alias("recent")] if last > 1 else []))

    def rows(self) -> DataFrame:
        """Every row with a ``fired`` flag."""
        at = F.transform("_run.hits", lambda h: h["at"])
        flagged = F.transform(F.col("_rows"), lambda x, i: F.struct(
            x.alias("x"), F.array_contains(at, i + 1).alias("fired")))
        row = each(self._blocks, "_f", flagged).filter(~F.col("_f.x.halo"))
        return row.select(*self._keys, F.col("_f.x.order").alias(self._order),
                          *[F.col(f"_f.x.{e}").alias(e) for e in self._extras], F.col("_f.fired").alias("fired"))

    def final(self) -> DataFrame:
        """Per key: the counter left over, the grand total, the firings."""
        end = F.struct("_run.left", "_run.total", "_run.fires")
        return (
            self._blocks.groupBy(*self._keys).agg(F.max_by(end, BLOCK).alias("_end"))
            .select(*self._keys, F.col("_end.left").alias("since"), F.col("_end.total").alias("total"),
                    F.col("_end.fires").alias("fires"))
        )


def reset_trigger(df: DataFrame, keys, order: str, size, limit, extras=(), start=0, reset=0,
                  lookback=0, top=None, bits=BITS, super_bits=SUPER_BITS) -> Triggered:
    """Fire whenever the growing counter reaches ``limit``, then reset it.

    ``order`` is the dense position (0, 1, 2 …) of a row in its key, ``top`` the
    highest there can be (see :func:`~colloquy.operators.blocks.top_of`). ``size``
    is what a row adds (not negative), ``limit`` a column: null never fires,
    0 fires at once unless nothing was added yet. The counter begins at
    ``start`` and falls to ``reset`` after a firing.
    """
    keys = list(keys)
    size = F.col(size) if isinstance(size, str) else size
    limit = F.col(limit) if isinstance(limit, str) else F.lit(limit) if isinstance(limit, int) else limit
    rows = df.select(*keys, order, size.cast("bigint").alias("_size"),
                     F.coalesce(limit.cast("bigint"), F.lit(NEVER)).alias("_limit"), *extras)
    levels = levels_for(top, bits, super_bits)
    if levels:
        rows = with_halo(rows, order, lookback, bits)
    else:
        rows = rows.withColumn(BLOCK, F.lit(0).cast("bigint")).withColumn("_halo", F.lit(False))
    packed = F.struct(
        F.col(order).alias("order"),
        F.when(F.col("_halo"), 0).otherwise(F.col("_size")).cast("bigint").alias("size"),
        F.when(F.col("_halo"), NEVER).otherwise(F.col("_limit")).cast("bigint").alias("limit"),
        F.col("_halo").alias("halo"), *extras)
    blocks = rows.groupBy(*keys, BLOCK).agg(F.sort_array(F.collect_list(packed)).alias("_rows"))
    if not levels:
        alone = _fold(F.col("_rows"), F.lit(start), F.lit(0), F.lit(0), reset)
        return Triggered(blocks.withColumn("_run", alone), keys, order, extras, lookback)
    if lookback:
        # A copied tail without rows of its own is no block.
        blocks = blocks.filter(~F.element_at("_rows", -1)["halo"])
    starts = _start_states(blocks, keys, start, reset, levels, super_bits)
    run = _fold(F.col("_rows"), F.coalesce("state", F.lit(start)), F.coalesce("grown", F.lit(0)),
                F.coalesce("fired", F.lit(0)), reset)
    done = blocks.join(starts, [*keys, BLOCK], "left").select(*keys, BLOCK, "_rows", run.alias("_run"))
    return Triggered(done, keys, order, extras, lookback)
