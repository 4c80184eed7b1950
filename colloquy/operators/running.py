"""Running totals, counts and last values in arrival order."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.operators.blocks import BLOCK, SUPER, SUPER_BITS, block_of, levels_for

RUN_BITS = 16  # narrow rows per window group: 65536


def _first_known(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


# kind -> (aggregate of raw values, aggregate of block results, combine(later, earlier))
_KINDS = {
    "sum": (F.sum, F.sum, lambda late, early: F.coalesce(late + early, late, early)),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
    "last": (None, None, _first_known),
}


def _over(kind, column, window):
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return _KINDS[kind][0](column).over(window)


def _total(kind, column, order, reverse):
    if kind != "last":
        return _KINDS[kind][1](column)
    pick = F.min_by if reverse else F.max_by
    return pick(column, F.when(column.isNotNull(), F.col(order)))


def with_running(df: DataFrame, keys, order: str, outs: dict, reverse=False,
                 inclusive=True, top=None, bits=RUN_BITS, super_bits=SUPER_BITS) -> DataFrame:
    """Add running aggregates per key in the order of ``order``.

    ``outs`` maps a new column to ``(kind, column)`` with kind ``sum``,
    ``count``, ``max``, ``min`` or ``last`` (last non-null value). ``order``
    holds non-negative integers, unique within a key. With ``inclusive=False``
    a row's own value is left out; ``reverse`` runs from the end.

    ``top`` is the highest order there can be, see
    :func:`~colloquy.operators.blocks.top_of`. Up to two levels of blocks keep
    every window group bounded; keys that fit in one block get no carry row, so
    the carry join has next to nothing to move.
    """
    keys = list(keys)
    parts = {}
    for name, (kind, column) in outs.items():
        column = F.lit(1) if kind == "count" else (F.col(column) if isinstance(column, str) else column)
        parts[name] = ("sum" if kind == "count" else kind, column.cast("bigint") if kind == "count" else column)
    raw = {name: f"_raw_{name}" for name in parts}

    based = df.withColumn(BLOCK, block_of(order, bits))
    for name, (_, column) in parts.items():
        based = based.withColumn(raw[name], column)

    def edge(by):
        return F.col(by).desc() if reverse else F.col(by).asc()

    def frame(window, own):
        return window.rowsBetween(Window.unboundedPreceding, 0 if own else -1)

    levels = levels_for(top, bits, super_bits)
    local = based
    w_row = frame(Window.partitionBy(*keys, *([BLOCK] if levels else [])).orderBy(edge(order)), own=inclusive)
    for name, (kind, _) in parts.items():
        local = local.withColumn(f"_l_{name}", _over(kind, F.col(raw[name]), w_row))
    kept = [c for c in df.columns if c not in parts]
    if not levels:
        return local.select(*kept, *[F.col(f"_l_{n}").alias(n) for n in parts])

    totals = (
        based.groupBy(*keys, BLOCK)
        .agg(*[_total(k, F.col(raw[n]), order, reverse).alias(n) for n, (k, _) in parts.items()])
        .withColumn(SUPER, F.shiftright(BLOCK, super_bits) if levels == 2 else F.lit(0))
    )
    w_block = frame(Window.partitionBy(*keys, SUPER).orderBy(edge(BLOCK)), own=False)
    carried = totals.select(
        *keys, SUPER, BLOCK, *[_over(k, F.col(n), w_block).alias(f"_c_{n}") for n, (k, _) in parts.items()])
    if levels == 2:
        w_super = frame(Window.partitionBy(*keys).orderBy(edge(SUPER)), own=False)
        supers = totals.groupBy(*keys, SUPER).agg(
            *[_total(k, F.col(n), BLOCK, reverse).alias(n) for n, (k, _) in parts.items()])
        supers = supers.select(*keys, SUPER, *[_over(k, F.col(n), w_super).alias(f"_s_{n}") for n, (k, _) in parts.items()])
        supers = supers.filter(_any_known([f"_s_{n}" for n in parts]))
        carried = carried.join(supers, [*keys, SUPER], "left").select(*keys, BLOCK, *[
            _KINDS[k][2](F.col(f"_c_{n}"), F.col(f"_s_{n}")).alias(f"_c_{n}") for n, (k, _) in parts.items()])
    carried = carried.filter(_any_known([f"_c_{n}" for n in parts])).drop(SUPER)
    joined = local.join(carried, [*keys, BLOCK], "left")
    return joined.select(*kept, *[
        _KINDS[k][2](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, _) in parts.items()])


def _any_known(names):
    return reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])


def with_position(df: DataFrame, keys, order: str, name="pos", **blocks) -> DataFrame:
    """Number the rows of every key 0, 1, 2 … in order, without gaps."""
    counted = with_running(df, keys, order, {name: ("count", None)}, **blocks)
    return counted.withColumn(name, F.col(name) - 1)
