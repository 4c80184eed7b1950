"""Document fingerprints from closed syncmers.

A stretch of 16 code points is chosen where the smallest hash among its nine
inner stretches of 8 is the first or the last. Whether it is chosen depends on
these 16 code points alone, so equal passages have equal anchors wherever they
stand, and an edit moves no anchor outside itself. A fingerprint is the sketch
of a text's set of anchors: the smallest hashes of the whole set, from which
the share of common anchors of two texts is estimated without bias.
"""

import base64

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import partitions, slices

K, S = 16, 8        # lengths of anchors and of their inner stretches
SKETCH = 128        # hashes in a fingerprint: the likeness has a standard error of 0.045 at most
_B = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of stretches of 2n from those of n."""
    factor = pow(int(_B), n, 1 << 64)
    return h[:-n] * np.uint64(factor) + h[n:]


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's closed syncmers; a text shorter than 16 is one anchor, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _mixed(codes.astype(np.uint64) + np.uint64(1))
    if len(h) < K:
        value = np.full(min(1, len(h)), len(h), np.uint64)
        for i in range(len(h)):
            value = _mixed(value * _B + h[i:i + 1])
        return np.zeros(len(value), np.int64), value
    for n in (1, 2, 4):
        h = _doubled(h, n)
    whole, inner = _doubled(h, 8), _mixed(h)
    low = inner
    for n in (1, 2, 4):
        low = np.minimum(low[:-n], low[n:])
    first, last = inner[:-8], inner[8:]
    at = np.flatnonzero(np.minimum(low[:-1], last) == np.minimum(first, last))
    return at, _mixed(whole[at])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest distinct hashes, their upper 32 bits, in order."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    take = 4 * SKETCH
    while take < len(values):  # a few of the smallest are enough unless they repeat
        few = np.unique(np.partition(values, take)[:take])
        if len(few) >= SKETCH:
            return few[:SKETCH]
        take *= 4
    return np.unique(values)[:SKETCH]


def to_string(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u4").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common anchors, from two sketches; 1 for two empty texts."""
    both = np.union1d(a, b)[:SKETCH]
    if not len(both):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum() / len(both))


def align(a: str, b: str) -> list[tuple[int, int, int]]:
    """Passages that two texts share: (begin in a, begin in b, length), by anchors at one common distance.

    Anchors that occur more than once in a text are left to their neighbours.
    """
    (pa, ha), (pb, hb) = anchors(a), anchors(b)
    ua, ia, ca = np.unique(ha, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(hb, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
    left, right = pa[ia[ca == 1][xa]], pb[ib[cb == 1][xb]]
    order = np.lexsort((left, right - left))
    spans = []
    for i, j in zip(left[order].tolist(), right[order].tolist()):
        if spans and spans[-1][1] - spans[-1][0] == j - i and i <= spans[-1][0] + spans[-1][2]:
            spans[-1][2] = i + min(K, len(a)) - spans[-1][0]
        else:
            spans.append([i, j, min(K, len(a))])
    return sorted(map(tuple, spans))


def fingerprints(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every whole text; null texts count as empty. One pass, no shuffle."""
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = [to_string(sketch(anchors(t or "")[1])) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _bucket(key, bounds: list[int], low=0, high=None):
    """How many bounds are at or below ``key``, as a balanced tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < bounds[middle], _bucket(key, bounds, low, middle)).otherwise(_bucket(key, bounds, middle + 1, high))


def with_next(df: DataFrame, each, schema: str, id_col="doc_id", text_col="text", per_partition=4) -> DataFrame:
    """``each(id, text, next text, memo)`` for every row, in descending ``id_col`` order; after the last comes the first.

    Rows are cut into ranges of ids at quantiles and each range is sorted and
    streamed. The first row of a range is copied behind the range before it in
    that order, so every row meets its successor and each text is moved once.
    Only the bounds and highest ids of the ranges come to the driver. Null ids
    count as the smallest. Rows with equal ids stand in the order of their
    texts' hashes. ``memo`` is a dict of the current and the next text that
    lets a result be carried over.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_key"), F.col(id_col).cast("bigint").alias("_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ranges = partitions(spark) * per_partition
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = rows.agg(F.percentile_approx("_key", shares, max(10_000, 10 * ranges))).first()[0] or []
    bounds = sorted(set(bounds))
    rows = rows.withColumn("_range", _bucket(F.col("_key"), bounds))
    tops = {r["_range"]: r["top"] for r in rows.groupBy("_range").agg(F.max("_key").alias("top")).collect()}
    filled = sorted(tops)
    goes = {filled[i]: filled[(i + 1) % len(filled)] for i in range(len(filled))}  # whose end this range's first row follows
    firsts = spark.createDataFrame([(r, tops[r], goes[r]) for r in filled] or [(None, None, None)], "_range int, _key bigint, _goes int")
    copied = rows.join(F.broadcast(firsts), ["_range", "_key"], "left")  # as many rows as ranges
    copied = copied.withColumn("_end", F.explode(F.when(F.col("_goes").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = copied.select(F.when(F.col("_end"), F.col("_goes")).otherwise(F.col("_range")).alias("_range"), "_end", "_id", "_text",
                          F.col("_key"), F.xxhash64("_text").alias("_hash"))
    dealt = dealt.repartition(partitions(spark), "_range").sortWithinPartitions("_range", "_end", F.desc("_key"), "_hash", "_text")

    def run(batches):
        import pyarrow as pa

        kinds = None
        here, waiting, memo, out, size = None, None, {}, [], 0
        for batch in slices(batches):
            for where, end, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if where != here:
                    here, waiting, memo = where, None, {}
                if waiting is not None:
                    out.append(each(*waiting, text, memo))
                    size += len(text) + 1000
                waiting = None if end else (key, text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return dealt.select("_range", "_end", "_id", "_text").mapInArrow(run, schema)


def edited(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, with the next text too.

    The edited text has its last third (rounded down, in code points) replaced
    by as many first code points of the next document, or all it has.
    """
    def each(key, text, following, memo):
        import hashlib

        own = memo.get("next")
        if own is None:
            own = sketch(anchors(text)[1])
        memo["next"] = after = sketch(anchors(following)[1])
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        other = sketch(anchors(changed)[1])
        return {id_col: key, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": to_string(own), "edited_fingerprint": to_string(other),
                "near_edited": likeness(own, other), "near_next": likeness(own, after)}

    return with_next(df, each, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                               "edited_fingerprint string, near_edited double, near_next double", id_col, text_col)
