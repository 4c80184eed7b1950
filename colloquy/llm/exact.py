"""Exact duplicates by progressive refinement: length, then hash of the first characters, then hash of the whole.

Texts are compared without their white space. The first pass over the texts
writes a narrow table: length, hash of the head. Rows whose length occurs
once are settled; of the others, rows whose length and head occur once. The
second pass hashes the whole texts of the groups that survive. Only ids,
lengths and digests are shuffled, never texts, and all sums are combined before
they are shuffled. Built-in functions only.

A group of any size is its row count and its best row, both plain aggregates.
Groups are joined back to their rows in two ways: the few groups that hold more
than a ten-thousandth of all rows are broadcast (there are at most ten thousand
of them), so that no key of a shuffled join is hot.
"""

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import BROADCAST_ROWS, cut_lineage, small_side

HEAD = 64               # characters of the head
HOT_SHARE = 10_000      # a group with more than this part of all rows is joined by broadcast
#: Fixed value: the characters left out, U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normal(text_col: str) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, "")


def _best() -> Column:
    """The row that stays: most characters, then smallest id, null last."""
    return F.min(F.struct((-F.col("_chars")).alias("less"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (unique ``keys``, ``_size``), hot groups apart."""
    least = max(total // HOT_SHARE, 1)
    hot = groups.filter(F.col("_size") > least)
    marks = hot.select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(marks), keys, "left")
    many = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys)
    few = marked.filter("_hot is null").drop("_hot").join(groups.filter(F.col("_size") <= least), keys, "left")
    return many.unionByName(few)


def _resolve(df: DataFrame, id_col, text_col, hash_all) -> tuple[DataFrame, DataFrame, int]:
    """Rows alike in all that counts, with ``_copies``; groups of more than one row; the number of all rows."""
    texts = df.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("bigint").alias("_chars"),
                      normal(text_col).alias("_text"))
    size, head = F.length("_text").alias("_length"), F.xxhash64(F.substring("_text", 1, HEAD)).alias("_head")
    narrow = cut_lineage(texts.select(size, head))
    # First and second step: lengths, then heads within a length, that occur more than once.
    lengths = cut_lineage(narrow.groupBy("_length").agg(F.count("*").alias("_n")))
    total = lengths.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    again = lengths.filter("_n > 1").select("_length")
    cells = cut_lineage(narrow.join(small_side(again), "_length", "left_semi").groupBy("_length", "_head").agg(F.count("*").alias("_size"))
                        .filter("_size > 1"))
    # Third step: whole texts of what survives. Broadcast cells reach the texts before they are hashed; more cells
    # than may be broadcast are joined after it, since a digest is cheaper to shuffle than a text.
    digest, keys = F.sha2(F.col("_text"), 256), ["_length", "_head"]
    whole = texts.select("_id", "_chars", "_text", size, head)
    if cells.count() <= BROADCAST_ROWS:
        marks = F.broadcast(cells.select(*keys, F.lit(True).alias("_alive")))
        rows = whole.join(marks, keys, "left").withColumn("_hash", digest if hash_all else F.when(F.col("_alive"), digest))
    else:
        rows = _with_groups(cut_lineage(whole.withColumn("_hash", digest).drop("_text")), cells, keys, total) \
            .withColumn("_alive", F.when(F.col("_size").isNotNull(), True)).drop("_size")
        rows = rows if hash_all else rows.withColumn("_hash", F.when(F.col("_alive"), F.col("_hash")))
    # Rows alike become one with a count, so a row repeated in bulk is no hot key. A row that is settled is the only one of its head.
    rows = cut_lineage(rows.groupBy("_length", "_head", "_hash", "_id", "_chars", "_alive").agg(F.count("*").alias("_copies")))
    groups = cut_lineage(rows.filter("_alive").groupBy("_length", "_hash").agg(F.sum("_copies").alias("_size"), _best().alias("_top"))
                         .filter("_size > 1").select("_length", "_hash", "_size", F.col("_top.id").alias("_keep"), (-F.col("_top.less")).alias("_most")))
    return rows, groups, total


def classes(df: DataFrame, id_col="doc_id", text_col="text", hash_all=False) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row.

    Texts are equal if they are so without the characters of :data:`BLANKS`;
    null counts as empty, and all texts of white space are equal to it. Of a
    group the row with the most characters stays, of those the one of the
    smallest id, a null id last: ``keep_id`` is its id, null if all ids of the
    group are null. Of rows alike in id and length one is kept. ``text_sha256``
    is the hex digest of the text without white space; only rows that survive
    to the last step have one, others null, unless ``hash_all``. An empty table
    gives none. Other columns are left out, whatever their names.
    """
    rows, groups, total = _resolve(df, id_col, text_col, hash_all)
    found = _with_groups(rows, groups, ["_length", "_hash"], total)
    alone, block = F.col("_size").isNull(), 1 << 16
    best = alone | (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_most")))
    # Copies come out in blocks, so no array grows with them.
    found = found.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {block}"))))
    found = found.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {block}, least(_copies, (_block + 1) * {block}) - 1)")))
    return found.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"), (best & (F.col("_copy") == 0)).alias("kept"), F.col("_hash").alias("text_sha256"))


def keep(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``df``, with all its columns, without the rows that :func:`classes` drops; of rows alike in id and length any one stays.

    Groups are joined to the texts by digest; texts are shuffled only if there
    are more groups than may be broadcast.
    """
    rows, groups, total = _resolve(df, id_col, text_col, False)
    groups = small_side(cut_lineage(groups.select(F.col("_hash").alias("_key"), "_size", "_keep", "_most")))
    chars = F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    each = df.select(F.struct("*").alias("_row"), F.sha2(normal(text_col), 256).alias("_key"), chars.alias("_chars"), F.col(id_col).alias("_id"))
    each = each.join(groups, "_key", "left")
    stay = each.filter(F.col("_size").isNotNull() & F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_most")))
    return each.filter("_size is null").unionByName(stay.dropDuplicates(["_key"])).select("_row.*")
