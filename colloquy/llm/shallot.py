"""Exact k-means over integer vectors by Shallot search.

Each vector carries its centroid, its second-nearest centroid, and two bounds:
no less than the distance to the first, no more than the distance to any other.
When centroids move, the bounds move with them, and most vectors are settled by
the bounds alone. The others measure both remembered centroids, start from the
closer one and scan its neighbours in ascending distance. A centroid further
from the start than the two best distances together cannot come in, so the ball
shrinks whenever a better centroid is found. What survives is compared in exact
integers; of equal distances the smaller number wins. Bounds are rounded away
from the truth, so no rounding can settle a vector wrongly.

Vectors are packed in blocks of rows once; a round is one pass over the blocks,
without a shuffle. The driver receives sums of what has moved: a row for each
component of each centroid, whatever the number of vectors.
"""

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import cut_lineage

#: Components up to this magnitude keep squared distances of 64 components within 64 bits; larger ones take Python's integers.
PLAIN = 1 << 27
_LESS, _MORE = 1 - 1e-15, 1 + 1e-15


def usable(column: str, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null, infinite or no number."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(column) == dims) & finite, F.lit(False))


def whole_numbers(rows, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each component: 64-bit integers, or Python's where these would not be exact."""
    scaled = np.floor(np.asarray(rows, np.float64) * scale)
    if not np.isfinite(scaled).all():
        raise ValueError("components beyond the range of doubles")
    if len(scaled) and np.abs(scaled).max() > PLAIN:
        return np.array([[int(x) for x in row] for row in scaled], object)
    return scaled.astype(np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    gap = vectors - centroids
    return (gap * gap).sum(axis=-1)


def root(values) -> np.ndarray:
    return np.sqrt(np.asarray(values, np.float64))


class Ground:
    """What all vectors of a round need to know of the centroids: k numbers each, and k squared."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        large = max((abs(x) for c in centroids + (before or []) for x in c), default=0) > PLAIN
        self.places = np.array(centroids, object if large else np.int64)
        k = len(centroids)
        apart = root([squared(self.places, c) for c in self.places]) if k else np.zeros((0, 0))
        self.order = np.argsort(apart, axis=1, kind="stable")           # the centroid itself may stand behind its equals
        self.near = np.take_along_axis(apart, self.order, 1) * _LESS
        others = np.where(np.eye(k, dtype=bool), np.inf, apart)
        self.half = others.min(axis=1, initial=np.inf) / 2 * _LESS
        moved = root(squared(self.places, np.array(before, self.places.dtype))) * _MORE if before else np.zeros(k)
        self.moved = moved
        self.most = np.array([np.delete(moved, j).max(initial=0) for j in range(k)])


def search(vectors: np.ndarray, first, second, upper, lower, ground: Ground) -> tuple:
    """First and second centroid of each vector and their bounds, after centroids have moved. Arrays are changed in place."""
    k = len(ground.places)
    upper[:] = (upper + ground.moved[first]) * _MORE
    lower[:] = lower - ground.most[first] - 1e-15 * (np.abs(lower) + ground.most[first])
    settled = np.maximum(lower, ground.half[first])
    open_ = np.flatnonzero(upper >= settled)
    if not len(open_):
        return first, second, upper, lower
    # The true distance to the first may settle it.
    best = squared(vectors[open_], ground.places[first[open_]])
    upper[open_] = root(best) * _MORE
    left = upper[open_] >= settled[open_]
    open_, best = open_[left], best[left]
    if not len(open_) or k < 2:
        return first, second, upper, lower
    one, two = first[open_], second[open_]
    next_ = squared(vectors[open_], ground.places[two])
    swap = (next_ < best) | ((next_ == best) & (two < one))
    one, two = np.where(swap, two, one), np.where(swap, one, two)
    best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
    start, radius, seen = one.copy(), root(best) * _MORE, (one.copy(), two.copy())
    going = np.arange(len(open_))
    for rank in range(k):
        inside = ground.near[start[going], rank] <= (radius[going] + root(next_[going])) * _MORE
        going = going[inside]
        if not len(going):
            break
        other = ground.order[start[going], rank]
        new = (other != seen[0][going]) & (other != seen[1][going])
        at, other = going[new], other[new]
        here = squared(vectors[open_[at]], ground.places[other])
        first_now = (here < best[at]) | ((here == best[at]) & (other < one[at]))
        second_now = ~first_now & ((here < next_[at]) | ((here == next_[at]) & (other < two[at])))
        up = at[first_now]
        two[up], next_[up] = one[up], best[up]
        one[up], best[up] = other[first_now], here[first_now]
        up = at[second_now]
        two[up], next_[up] = other[second_now], here[second_now]
    first[open_], second[open_] = one, two
    upper[open_], lower[open_] = root(best) * _MORE, root(next_) * _LESS
    return first, second, upper, lower


def begin(vectors: np.ndarray, ground: Ground) -> tuple:
    """The state of vectors that remember nothing yet: every centroid is measured."""
    n, k = len(vectors), len(ground.places)
    every = np.stack([squared(vectors, c) for c in ground.places], axis=1)
    order = np.argsort(every, axis=1, kind="stable")    # of equals the smaller number first
    first = order[:, 0].astype(np.int32)
    second = order[:, 1].astype(np.int32) if k > 1 else first.copy()
    rows = np.arange(n)
    return first, second, root(every[rows, first]) * _MORE, root(every[rows, second]) * _LESS if k > 1 else np.full(n, np.inf)


def _pack(values: np.ndarray) -> bytes:
    return values.tobytes() if values.dtype != object else "\n".join(" ".join(map(str, row)) for row in values).encode()


def _unpack(content: bytes, plain: bool, dims: int) -> np.ndarray:
    if plain:
        return np.frombuffer(content, np.int64).reshape(-1, dims)
    return np.array([[int(x) for x in row.split()] for row in content.decode().split("\n")], object)


def _state(first, second, upper, lower) -> bytes:
    return b"".join((first.astype("<i4").tobytes(), second.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes()))


def _remembered(content: bytes, n: int) -> tuple:
    return (np.frombuffer(content, "<i4", n).astype(np.int32), np.frombuffer(content, "<i4", n, 4 * n).astype(np.int32),
            np.frombuffer(content, "<f8", n, 8 * n).copy(), np.frombuffer(content, "<f8", n, 16 * n).copy())


def blocks(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """The usable vectors in blocks of rows: ``ids``, ``plain``, ``vectors``; stored, so later rounds don't read floats again."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors = whole_numbers(flat.reshape(batch.num_rows, dims), scale)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([vectors.dtype != object]), pa.array([_pack(vectors)], pa.binary())],
                names=["ids", "plain", "vectors"])

    rows = df.filter(usable(vec_col, dims)).select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    return cut_lineage(rows.mapInArrow(run, f"ids array<{kind}>, plain boolean, vectors binary"))


def _round(state: DataFrame, ground: Ground, dims: int, started: bool) -> DataFrame:
    """One assignment: the blocks with their new state and ``delta``, what each centroid's count and sums gain or lose."""
    k = len(ground.places)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            states, deltas = [], []
            for content, plain, known in zip(*(batch.column(c).to_pylist() for c in ("vectors", "plain", "state"))):
                vectors = _unpack(content, plain, dims)
                n = len(vectors)
                if started:
                    old = _remembered(known, n)
                    now = search(vectors, *(x.copy() for x in old), ground)
                    moved = np.flatnonzero(now[0] != old[0])
                else:
                    now, moved = begin(vectors, ground), np.arange(n)
                delta = np.zeros((k, dims + 1), vectors.dtype)
                gain = np.concatenate([np.ones((len(moved), 1), np.int64), vectors[moved]], axis=1)
                np.add.at(delta, now[0][moved], gain)
                if started:
                    np.subtract.at(delta, old[0][moved], gain)
                states.append(_state(*now))
                deltas.append([str(x) for x in delta.ravel().tolist()] if len(moved) else [])
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("plain"), batch.column("vectors"), pa.array(states, pa.binary()),
                                              pa.array(deltas, pa.list_(pa.string()))], names=["ids", "plain", "vectors", "state", "delta"])

    kind = state.schema["ids"].dataType.simpleString()
    return state.select("ids", "plain", "vectors", "state").mapInArrow(
        run, f"ids {kind}, plain boolean, vectors binary, state binary, delta array<string>")


def starts(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int, k: int, salt: str) -> list[list[int]]:
    """The first centroids: the ``k`` usable vectors whose ids' hashes are smallest; of equal ids the smaller vector first."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    vector = F.col(vec_col).cast("array<double>")
    rows = df.filter(usable(vec_col, dims)).select(order.alias("_order"), vector.alias("_vec")).orderBy("_order", "_vec").limit(k)
    return [[int(x) for x in whole_numbers([r["_vec"]], scale)[0]] for r in rows.collect()]


def cluster(df: DataFrame, k=8, rounds=10, dims=64, scale=1024, salt="3:", id_col="vec_id", vec_col="embedding") -> DataFrame:
    """``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every usable vector.

    Vectors with another number of components, or with a null, an infinite or
    no number among them, are left out; null vectors are so too. Each component
    becomes ``floor(scale * x)``. ``rounds`` times every vector goes to the
    nearest centroid, then every centroid that has vectors becomes the floor of
    their mean in each component; then vectors are assigned once more. A round
    in which no centroid moves is the last one that needs work. Fewer than
    ``k`` vectors are their own centroids. Null ids count as an empty text in
    the hash; repeated rows are vectors of their own. No usable vector, no
    rows. Distances beyond 64 bits are an error. Other columns are left out.

    The state of all vectors is persisted from one round to the next and made
    anew from the stored blocks where an executor is lost.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    places = starts(df, id_col, vec_col, dims, scale, k, salt)
    state = blocks(df, id_col, vec_col, dims, scale).withColumn("state", F.lit(b""))
    k = len(places)
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    ground, held, started = Ground(places, None), None, False
    for number in range(rounds + 1 if k else 0):
        after = _round(state, ground, dims, started).persist(StorageLevel.MEMORY_AND_DISK)
        gains = after.select(F.posexplode("delta").alias("at", "gain")).groupBy("at").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain"))
        for row in gains.collect():         # a row for each component of each centroid
            j, i = divmod(row["at"], dims + 1)
            if i:
                sums[j][i - 1] += int(row["gain"])
            else:
                counts[j] += int(row["gain"])
        if held is not None:
            held.unpersist()
        state, held, started = after, after, True
        if number == rounds:
            break
        new = [[x // counts[j] for x in sums[j]] if counts[j] else places[j] for j in range(k)]
        if new == places:
            break
        ground, places = Ground(new, places), new
    return _report(spark, state, places, dims, kind, id_col)


def _report(spark, state: DataFrame, places: list[list[int]], dims: int, kind: str, id_col: str) -> DataFrame:
    """A row per vector from the last state, with sums over clusters."""
    import hashlib

    out = f"`{id_col}` {kind}, cluster int, distance bigint"
    if not places:
        return spark.createDataFrame([], out + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    ground = Ground(places, None)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, (content, plain, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vectors", "plain", "state")))):
                vectors = _unpack(content, plain, dims)
                first = _remembered(known, len(vectors))[0]
                distance = squared(vectors, ground.places[first])
                ids = batch.column("ids").slice(at, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(first, pa.int32()), pa.array([int(x) for x in distance], pa.int64())],
                                                 names=[id_col, "cluster", "distance"])

    rows = cut_lineage(state.select("ids", "plain", "vectors", "state").mapInArrow(run, out))
    state.unpersist()
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, place)).encode()).hexdigest()) for j, place in enumerate(places)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
