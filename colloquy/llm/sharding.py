"""Shards of bounded size by extendible hashing.

A directory is indexed by the first bits of a row's hash. It starts with one
bucket; only buckets over the byte limit are split on another bit, until every
bucket fits. Sizes are added up in one pass for eight further bits of all
oversized buckets, so the rounds grow with the logarithm of the data, and the
directory, with a row for each cell of a split bucket, stays a table.
"""

from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import cut_lineage, small_side

BITS = 60       # of the hash
STEP = 8        # bits per round


def row_hash(id_col="doc_id", text_col="text"):
    """60 bits of the md5 of id and text: only wholly equal rows have equal hashes."""
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def row_bytes(text_col="text"):
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")


def directory(rows: DataFrame, max_bytes: int) -> list[DataFrame]:
    """Levels of the directory for ``rows(_hash, _bytes)``.

    Level r: ``_cell`` (the first 8 (r + 1) bits), ``_depth`` (bits that its
    shard is told apart by; null: the bucket is split further) and
    ``shard_bytes``.
    """
    levels, active, used = [], rows, 0
    while used + STEP <= BITS:
        last = used + 2 * STEP > BITS
        cells = cut_lineage(active.groupBy(F.shiftright("_hash", BITS - used - STEP).alias("_cell")).agg(F.sum("_bytes").alias("_sum")))
        sized = cells.withColumn("_bits", F.explode(F.sequence(F.lit(0 if used == 0 else 1), F.lit(STEP)))) \
            .withColumn("_bucket", F.expr(f"shiftright(_cell, {STEP} - _bits)"))
        fits = sized.groupBy("_bits", "_bucket").agg(F.sum("_sum").alias("shard_bytes"))
        fits = fits.filter((F.col("shard_bytes") <= max_bytes) | (F.lit(last) & (F.col("_bits") == STEP)))
        chosen = sized.join(fits, ["_bits", "_bucket"]).groupBy("_cell").agg(F.min(F.struct(F.col("_bits"), F.col("shard_bytes"))).alias("_leaf"))
        level = cut_lineage(cells.join(chosen, "_cell", "left").select(
            "_cell", (F.col("_leaf._bits") + used).cast("int").alias("_depth"), F.col("_leaf.shard_bytes").alias("shard_bytes")))
        levels.append(level)
        split = level.filter("_depth is null").select("_cell")
        if split.isEmpty():
            break
        active = active.join(small_side(split), F.shiftright("_hash", BITS - used - STEP) == split["_cell"], "left_semi")
        used += STEP
    return levels


def assign(df: DataFrame, max_bytes: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``df`` with ``shard`` (its bits as a string), ``depth``, ``shard_bytes`` and ``overfull``.

    A shard is over the limit only if it is one row, or wholly equal rows, that
    exceed it together; ``overfull`` marks it. Null texts have no bytes; null
    ids are hashed by their text. Columns of ``df`` by these names are replaced.
    """
    rows = cut_lineage(df.select(row_hash(id_col, text_col).alias("_hash"), row_bytes(text_col).alias("_bytes")))
    out = df.drop("shard", "depth", "shard_bytes", "overfull").withColumn("_hash", row_hash(id_col, text_col)) \
        .withColumn("_depth", F.lit(None).cast("int")).withColumn("shard_bytes", F.lit(None).cast("bigint"))
    for r, level in enumerate(directory(rows, max_bytes)):
        known = small_side(level.select(F.col("_cell"), F.col("_depth").alias("_d"), F.col("shard_bytes").alias("_s")))
        out = out.join(known, F.when(F.col("_depth").isNull(), F.shiftright("_hash", BITS - STEP * (r + 1))) == known["_cell"], "left")
        out = out.withColumn("_depth", F.coalesce("_depth", "_d")).withColumn("shard_bytes", F.coalesce("shard_bytes", "_s")).drop("_cell", "_d", "_s")
    return out.withColumn("shard", F.expr(f"case when _depth = 0 then '' else lpad(bin(shiftright(_hash, {BITS} - _depth)), _depth, '0') end")) \
        .withColumn("overfull", F.col("shard_bytes") > max_bytes).withColumnRenamed("_depth", "depth").drop("_hash")


def write(df: DataFrame, folder: str, max_bytes: int, id_col="doc_id", text_col="text") -> None:
    """Write each shard to a folder of its own under ``folder``; each is bounded, so one task writes it."""
    assign(df, max_bytes, id_col, text_col).repartition("shard").write.partitionBy("shard").parquet(folder)
