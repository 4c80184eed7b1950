"""Blocks of consecutive positions.

Order-dependent operators never gather a whole meeting. A meeting is cut into
blocks of ``2**bits`` consecutive positions, the work inside a block runs in
one task, and only a small summary of every block is carried on to the later
blocks. Summaries are again cut into super-blocks, so that the largest group
stays bounded when one meeting holds a third of all rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = "_block"
SUPER = "_super"
BITS = 10        # rows per block: 1024
SUPER_BITS = 12  # blocks per super-block: 4096


def top_of(df: DataFrame, position: str) -> int:
    """The highest position in a table: the one figure plans are chosen by.

    A single-column maximum, cheap on stored tables. Where no key is longer
    than a block, operators need no carrying between blocks and say so by a
    shorter plan; longer keys get one or two levels of blocks.
    """
    return df.agg(F.max(F.col(position).cast("bigint"))).first()[0] or 0


def position_faults(df: DataFrame, keys, position: str) -> DataFrame:
    """Keys whose positions are not 0, 1, 2 … each once; empty for sound tables."""
    n, p = F.count("*"), F.col(position).cast("decimal(38,0)")
    sums = df.groupBy(*keys).agg(n.alias("rows"), F.min(position).alias("low"), F.max(position).alias("high"),
                                 F.sum(p).alias("_sum"), F.sum(p * p).alias("_squares"))
    last = F.col("rows").cast("decimal(38,0)") - 1
    sound = (F.col("low") == 0) & (F.col("high") == last) & (F.col("_sum") * 2 == last * (last + 1)) \
        & (F.col("_squares") * 6 == last * (last + 1) * (last * 2 + 1))
    return sums.filter(~F.coalesce(sound, F.lit(False))).drop("_sum", "_squares")


def levels_for(top, bits, super_bits) -> int:
    """Levels of carrying for positions up to ``top`` (None: unknown)."""
    if top is None:
        return 2
    return 0 if top >> bits == 0 else 1 if top >> (bits + super_bits) == 0 else 2


def block_of(position, bits=BITS) -> Column:
    return F.shiftright(F.col(position).cast("bigint"), bits)


def with_halo(df: DataFrame, position: str, rows: int, bits: int, flag="_halo") -> DataFrame:
    """Cut ``df`` into blocks that also hold the ``rows`` positions before them.

    Positions are dense, so the copies follow from arithmetic alone: the last
    rows of a block are repeated, marked, in the next block.
    """
    size = 1 << bits
    if not 0 <= rows <= size:
        raise ValueError("the halo must fit into one block")
    own = block_of(position, bits)
    repeat = F.pmod(F.col(position), F.lit(size)) >= size - rows
    steps = F.when(repeat, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("_step", F.explode(steps) if rows else F.lit(0))
        .withColumn(BLOCK, own + F.col("_step"))
        .withColumn(flag, F.col("_step") == 1)
        .drop("_step")
    )


def each(df: DataFrame, name: str, items) -> DataFrame:
    """One row per element of a costly list.

    A plain explode makes the optimizer infer a filter on the list's size and
    push it below the projection that builds the list, which would then be
    built twice; the outer form with a filter on its output builds it once.
    """
    return df.withColumn(name, F.explode_outer(items)).filter(F.col(name).isNotNull())
