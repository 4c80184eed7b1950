"""N-gram Jaccard join by PartEnum signatures, and the classes of its links.

A document is its set of word n-grams. Sets whose Jaccard similarity reaches
the threshold have sizes in the same or neighbouring size bands, and within a
band their Hamming distance is at most ``k``. The feature domain is cut into
more than ``k`` partitions by a hash; of sets that close at least
``spare + 1`` partitions are equal, so each set has one signature for every
partition it has features in and similar sets share one. A set with more than
``spare`` empty partitions could share empty ones only; it also enumerates the
partitions of a second cut, and if that leaves as many empty, the features of
its prefix in hash order, one of which similar sets share too. So no pair is lost.

Equal sets are one node. Signatures bring nodes together; an exact check of
the sets follows, in blocks of bounded size: each node with its anchor (the
smallest node it shares a signature with) and the nodes of the same block.
Then nodes of different classes that still share signatures are compared by
sketches: one bit a feature's hash value, set if an odd number of features
fall on it. Two sketches differ in no more bits than the sets in features, so
no similar pair is lost. Of the pairs they leave those that would connect the
classes are checked exactly first; where classes stay apart all the others
follow, in tasks that hold the sets and give one link for each two classes that
they join. So pairs and links grow with the classes, not with their square. Of
a node's signatures the most frequent are left out, as many as similar sets
share besides one. Nodes already in one class need no further check.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import cut_and_free, once, partitions, slices, small_side

BLOCK = 256     # nodes of a block that are compared with each other in one task
MEET = 4096     # nodes whose sketches are compared in one task; of long sets fewer
MEET_FEATURES = 1 << 23
NEAREST = 4     # pairs of a class that a task hands on in each round of connecting its classes
HELD = 1 << 19  # pairs that a task holds before it leaves out those that connect nothing
WAVE = 4        # sets moved at once when pairs are checked, as a multiple of all sets
SPARE = 0.15    # share of partitions beyond k + 1
_P = 0x9E3779B97F4A7C15
_MULT = np.uint64(_P)


def _mix(h, seed=0):
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    terms = _mix((raw[at].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))
    return _mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; with fewer words one for all of them, without words none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    short = len(words) < n
    size = len(words) if short else n
    h = np.full(len(words) - size + 1, size if short else 0, np.uint64)
    for i in range(size):
        h = _mix(h * _MULT + words[i:len(words) - size + 1 + i])
    return np.unique(h)


def node_of(features: np.ndarray) -> int:
    """A 63-bit digest that stands for a set."""
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little") >> 1


def bands(limit: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """Size bands (low, high) up to ``limit``; sets of one band, or of neighbouring ones, may be similar."""
    found, low = [], 1
    while low <= limit:
        high = max(low, low * den * den // (num * num))
        found.append((low, high))
        low = high + 1
    return tuple(found)


def shape(high: int, num: int, den: int) -> tuple[int, int]:
    """Number of partitions and spare ones for sets of up to ``high`` features."""
    k = 2 * high * (den - num) // (den + num)
    spare = max(1, -(-(k + 1) * 15 // 100)) if k else 0
    return k + 1 + spare, spare


def signatures(features: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """All signatures of a set, and how many of them any similar set shares at least.

    Similar sets agree in ``spare + 1`` partitions; those that are empty in both give no signature.
    """
    size, need = len(features), 1 << 30
    if not size:
        return np.zeros(0, np.uint64), 1
    limit = (1 << size.bit_length()) * (1 - -den * den // (num * num))  # the band after the set's own is known as well
    known = once("jaccard", (limit, num, den), 0, lambda: bands(limit, num, den))
    band = next(i for i, (_, high) in enumerate(known) if size <= high)
    tags = [band] if known[band + 1][0] * num > size * den else [band, band + 1]
    found = []
    for tag in tags:
        parts, spare = shape(known[tag][1], num, den)
        for seed in (1, 2):
            place = (_mix(features, seed) >> np.uint64(32)) % np.uint64(parts)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, place.astype(np.int64), _mix(features, 3))
            filled = np.flatnonzero(np.bincount(place.astype(np.int64), minlength=parts))
            found.append(_mix(sums[filled] + _mix((np.uint64(tag << 34 | seed << 32)) + filled.astype(np.uint64))))
            if parts - len(filled) <= spare:
                need = min(need, spare + 1 - (parts - len(filled))) if seed == 1 else 1
                break
        else:
            prefix = np.sort(_mix(features, 5))[:size - -(-size * num // den) + 1]
            found.append(_mix(prefix + np.uint64(tag), 7))
            need = 1
    return np.concatenate(found), need


def similar_pairs(sets: list[np.ndarray], others: list[np.ndarray] | None, num: int, den: int):
    """Indices (i, j) of similar pairs: within ``sets``, or of ``sets`` with ``others``. Exact."""
    every = sets if others is None else sets + others
    sizes = np.array([len(s) for s in every])
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), sizes)
    values, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1      # features of one set only are in no intersection
    keep = counts[which] > 1
    owner, which = owner[keep], shared[which[keep]]
    left = len(every) if others is None else len(sets)
    right = 0 if others is None else len(sets)
    common = np.zeros((left, len(every) - right), np.float32)
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    width = 4096
    for begin in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        low, high = np.searchsorted(which, [begin, begin + width])
        matrix = np.zeros((len(every), width), np.float32)
        matrix[owner[low:high], which[low:high] - begin] = 1
        common += matrix[:left] @ matrix[right:].T
    common = common.astype(np.int64)
    total = sizes[:left, None] + sizes[None, right:] - common
    hit = den * common >= num * total
    if others is None:
        hit = np.triu(hit, 1)
    return zip(*np.nonzero(hit))


def sketch(features: np.ndarray) -> bytes:
    """The parity of the number of features that fall on each bit: four to eight bits a feature, of long sets one or two."""
    power = 1 << (len(features) - 1).bit_length()
    bits = max(64, min(4 * power, max(2048, power)))
    place = (_mix(features, 9) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def close_pieces(sizes: np.ndarray, labels: np.ndarray, sketches: list[bytes], sides: np.ndarray | None, num: int, den: int):
    """``close_pairs`` in pieces of bounded size."""
    words = np.array([len(s) // 8 for s in sketches])
    tables = {w: np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(words == w)), np.uint64).reshape(-1, w) for w in np.unique(words).tolist()}
    for w, own in tables.items():
        at, others, folded = np.flatnonzero(words == w), [], []
        for more, table in tables.items():
            if w <= more and more * num < 2 * w * den:
                while table.shape[1] > w:   # halves laid upon each other are the sketch of half as many bits
                    table = table[:, :table.shape[1] // 2] ^ table[:, table.shape[1] // 2:]
                others.append(np.flatnonzero(words == more))
                folded.append(table)
        to, against = np.concatenate(others), np.concatenate(folded)
        step = max(1, (1 << 20) // against.size)
        for begin in range(0, len(at), step):
            here = at[begin:begin + step]
            apart = np.bitwise_count(own[begin:begin + step, None, :] ^ against[None]).sum(-1, dtype=np.int32)
            a, b = sizes[here][:, None], sizes[to][None]
            hit = (apart * (den + num) <= (a + b) * (den - num)) & (labels[here][:, None] != labels[to][None])
            hit &= (a * den >= b * num) & (b * den >= a * num) & ((here[:, None] < to[None]) | (words[to] > w)[None])
            if sides is not None:
                hit &= sides[here][:, None] != sides[to][None]
            i, j = np.nonzero(hit)
            if len(i):
                yield np.stack([here[i], to[j], apart[i, j]])


def close_pairs(sizes: np.ndarray, labels: np.ndarray, sketches: list[bytes], sides: np.ndarray | None, num: int, den: int):
    """Indices i, j and distances of all pairs of different labels, and sides, whose sketches and sizes do not rule out that they are similar."""
    return np.concatenate([np.zeros((3, 0), np.int64), *close_pieces(sizes, labels, sketches, sides, num, den)], axis=1)


def connecting(pairs: np.ndarray, own: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (i, j, distance) connect the classes ``own[i]``, numbered from 0, as all of them do, and the tree of each class.

    In each round every tree takes its ``limit`` nearest pairs to other trees,
    which leaves at most half of the trees that have any.
    """
    a, b = own[pairs[0]], own[pairs[1]]
    tree, keep = np.arange(len(own)), np.zeros(len(a), bool)
    while len(open_ := np.flatnonzero(tree[a] != tree[b])):
        ends, which = np.concatenate([tree[a[open_]], tree[b[open_]]]), np.concatenate([open_, open_])
        order = np.lexsort((which, pairs[2][which], ends))
        ends, which = ends[order], which[order]
        first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
        chosen = np.unique(which[np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends)))) < limit])
        keep[chosen] = True
        root = np.arange(len(tree))
        for x, y in zip(tree[a[chosen]].tolist(), tree[b[chosen]].tolist()):
            x, y = _root(root, x), _root(root, y)
            root[max(x, y)] = min(x, y)
        tree = np.array([_root(root, x) for x in range(len(root))])[tree]
    return keep, tree


def nearest(pieces, labels: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs those that connect the labels, a few for each label, and whether others of their tree are left out."""
    own = np.unique(labels, return_inverse=True)[1]
    kept, left, waiting = np.zeros((3, 0), np.int64), np.zeros(len(own), bool), []

    def reduced():
        pairs = np.concatenate([kept, *waiting], axis=1)
        keep, tree = connecting(pairs, own, limit)
        left[own[pairs[0][~keep]]] = True
        return pairs[:, keep], tree

    for piece in pieces:
        waiting.append(piece)
        if sum(p.shape[1] for p in waiting) >= HELD:
            kept, waiting = reduced()[0], []
    kept, tree = reduced()
    more = np.zeros(len(own), bool)
    more[tree[left]] = True
    return kept[0], kept[1], more[tree[own[kept[0]]]]


def _root(root, i):
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def spanning(nodes: list[int], pairs) -> list[tuple[int, int]]:
    """Links of the least node of each class to its other nodes."""
    root = list(range(len(nodes)))
    for i, j in pairs:
        a, b = _root(root, int(i)), _root(root, int(j))
        if a != b:
            root[b if nodes[a] < nodes[b] else a] = a if nodes[a] < nodes[b] else b
    return [(nodes[_root(root, i)], nodes[i]) for i in range(len(nodes)) if _root(root, i) != i]


def joining(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Similar pairs (i, j), one for each two classes that meet; between sides if there are two. Exact, block by block."""
    sizes, sketches = np.array([len(s) for s in sets]), [sketch(s) for s in sets]
    own, found = np.unique(labels, return_inverse=True)[1], []
    root = np.arange(len(own))
    blocks = [at[k:k + BLOCK] for at in (np.flatnonzero(sides == side) for side in np.unique(sides)) for k in range(0, len(at), BLOCK)]
    for x, one in enumerate(blocks):
        for y, two in enumerate(blocks[x:], x):
            if sides[one[0]] == sides[two[0]] and sides[one[0]]:
                continue
            at = one if x == y else np.concatenate([one, two])
            now = np.array([_root(root, k) for k in own[at]])
            across = None if x == y else np.arange(len(at)) >= len(one)
            i, j, _ = close_pairs(sizes[at], now, [sketches[k] for k in at], across, num, den)
            if not len(i):
                continue
            left = np.unique(np.concatenate([i, j]))
            right = left if x == y else left[left >= len(one)]
            left = left if x == y else left[left < len(one)]
            for i, j in similar_pairs([sets[k] for k in at[left]], None if x == y else [sets[k] for k in at[right]], num, den):
                i, j = at[left[i]], at[right[j]]
                a, b = _root(root, own[i]), _root(root, own[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(i), int(j)))
    return found


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, of batches sorted by them, as lists of the other columns' tuples."""
    here, rows = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != here:
                if rows:
                    yield here, rows
                here, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield here, rows


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node that links (a, b) lead to. Rounds grow with the logarithm of the longest path."""
    links = cut_and_free(links.select("a", "b").distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_and_free(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_label"))
        jump = labels.select(F.col("node").alias("_label"), F.col("label").alias("_further"))
        after = cut_and_free(lower.join(jump, "_label", "left").select("node", F.least("_label", "_further").alias("label"), "_old"))
        if after.filter("label <> _old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def nodes_of(df: DataFrame, n: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``_id``, ``_hash`` (of the text), ``_node``, ``_n`` (set size) of every row. One pass."""
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = [shingles(t, n) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64())], names=["_id", "_hash", "_node", "_n"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), _hash(text_col).alias("_hash"), F.col(text_col).cast("string").alias("_text")) \
        .mapInArrow(run, f"_id {kind}, _hash bigint, _node bigint, _n bigint")


def _hash(text_col: str):
    return F.xxhash64(F.col(text_col).cast("string"))


def candidates(df: DataFrame, n: int, num: int, den: int, text_col="text") -> DataFrame:
    """``sig``, ``node``, ``need``: nodes that share as many signatures with others as a similar set would; equal sets once."""
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = [s for t in batch.column(0).to_pylist() if len(s := shingles(t, n))]
            found = [signatures(s, num, den) for s in sets]
            ends = np.cumsum([0] + [len(f) for f, _ in found]).astype(np.int32)
            values = np.concatenate([f for f, _ in found]).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([min(n, 32767) for _, n in found], pa.int16()),
                                              pa.ListArray.from_arrays(ends, values)], names=["node", "need", "sigs"])

    each = df.select(F.col(text_col).cast("string")).mapInArrow(run, "node bigint, need smallint, sigs array<bigint>").dropDuplicates(["node"])
    rows = each.select("node", "need", F.explode("sigs").alias("sig"))
    same = Window.partitionBy("sig")
    shared = cut_and_free(rows.withColumn("_low", F.min("node").over(same)).withColumn("_top", F.max("node").over(same)).filter("_low < _top").drop("_low", "_top"))
    able = cut_and_free(shared.groupBy("node").agg(F.count("*").alias("_n"), F.first("need").alias("_need")).filter("_n >= _need").select("node"))
    return shared.join(small_side(able), "node").select("sig", "node", "need")


def _sets(df: DataFrame, rows: DataFrame, wanted: DataFrame, n: int, id_col, text_col) -> DataFrame:
    """``node``, ``size``, ``features``, ``sketch`` of the wanted nodes: the text of one document of each is read again."""
    one = cut_and_free(rows.join(wanted.select(F.col("node").alias("_node")), "_node", "left_semi")
                      .groupBy("_node").agg(F.min("_id").alias("_id"), F.count("_id").alias("_any")))
    ids = small_side(one.select("_id", "_node"))
    texts = df.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    texts = texts.join(ids, texts["_doc"].eqNullSafe(ids["_id"])).select("_node", "_text")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            nodes, sizes, found, drawn = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, n)
                if node_of(s) == node:   # other texts of the same id are not this node
                    nodes.append(node)
                    sizes.append(len(s))
                    found.append(s.tobytes())
                    drawn.append(sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(drawn, pa.binary())],
                                             names=["node", "size", "features", "sketch"])

    return cut_and_free(texts.mapInArrow(run, "node bigint, size bigint, features binary, sketch binary").dropDuplicates(["node"]))


def links(df: DataFrame, rows: DataFrame, n: int, num: int, den: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Links (a, b) that connect all nodes with similar sets, directly or by a chain of similar sets."""
    spark = df.sparkSession
    same = Window.partitionBy("sig")
    near = cut_and_free(candidates(df, n, num, den, text_col).withColumn("pivot", F.min("node").over(same)))
    anchors = cut_and_free(near.groupBy("node").agg(F.min("pivot").alias("anchor")))
    crowd = anchors.groupBy("anchor").agg(F.count("*").alias("_many"))
    blocks = cut_and_free(anchors.join(crowd, "anchor").select(
        "node", "anchor", F.pmod(F.xxhash64("node"), F.ceil(F.col("_many") / BLOCK)).alias("block")))
    sets = _sets(df, rows, anchors, n, id_col, text_col)

    def within(batches):
        import pyarrow as pa

        for _, members in _groups(batches, 2):
            nodes = [m[0] for m in members]
            found = spanning(nodes, similar_pairs([np.frombuffer(m[1], np.uint64) for m in members], None, num, den))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

    # Every block, its anchor included.
    own = blocks.filter("node <> anchor").select("anchor", "block", "node")
    with_anchor = own.unionByName(own.select("anchor", "block", F.col("anchor").alias("node")).distinct())
    first = cut_and_free(with_anchor.join(sets, "node").select("anchor", "block", "node", "features")
                        .repartition(partitions(spark), "anchor", "block").sortWithinPartitions("anchor", "block", "node")
                        .mapInArrow(within, "a bigint, b bigint"))
    labels = components(first)

    # Signatures whose nodes were not all compared in one block and are in several classes.
    placed = cut_and_free(blocks.join(labels, "node", "left").select("node", "anchor", F.xxhash64("anchor", "block").alias("place"), F.coalesce("label", "node").alias("label"))
                          .join(sets.select("node", "size"), "node"))
    rest = cut_and_free(_meeting(near.join(small_side(placed), "node"), same))
    if rest.isEmpty():
        return first
    rows = rest.join(sets.select("node", "sketch"), "node").select("node", "label", "size", "sketch", F.explode("meets").alias("_meet")) \
        .select("_meet.task", "_meet.side", "node", "label", "size", "sketch")
    hits = _hits(rows, num, den, NEAREST)
    first = first.unionByName(_checked(cut_and_free(hits.select("a", "b").distinct()), sets, num, den))
    if hits.filter("more").isEmpty():
        return first
    # Classes that have more pairs than were checked, and are still apart.
    now = components(first).select("node", "label")
    one, two = now.select(F.col("node").alias("a"), F.col("label").alias("_a")), now.select(F.col("node").alias("b"), F.col("label").alias("_b"))
    apart = hits.filter("more").join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    again = cut_and_free(apart.select("task").distinct())
    if again.isEmpty():
        return first
    rows = rows.join(again, "task", "left_semi").drop("label").join(now, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return first.unionByName(_joined(rows.select("task", "side", "node", "label", "size", "sketch"), sets, num, den))


def _meeting(members: DataFrame, same) -> DataFrame:
    """``node``, ``label``, ``size``, ``meets``: the tasks, as (``task``, ``side``), in which a node meets those of other classes."""
    rows = members.select("sig", "node", "need", "label", "size", "place", F.when(F.col("node") != F.col("pivot"), F.col("anchor") == F.col("pivot")).alias("_by_pivot"))
    others = F.when(F.col("_by_pivot").isNotNull(), F.col("place"))
    found = {"_l": F.min("label"), "_h": F.max("label"), "_a": F.min(others), "_b": F.max(others), "_by": F.min("_by_pivot"), "_c": F.min("place"), "_d": F.max("place"), "_many": F.count("*")}
    rows = rows.withColumns({name: value.over(same) for name, value in found.items()}).filter("_l < _h and not (_a = _b and _by) and not (_c = _d)")
    # Similar sets share ``need`` signatures: the rarest of these is behind all but the most frequent ones of either node.
    hottest = Window.partitionBy("node").orderBy(F.desc("_many"), "sig")
    rows = rows.withColumn("_passed", F.row_number().over(hottest)).filter("_passed >= need").select("sig", "node", "label", "size")
    # Signatures with the same least node meet in one place: near copies share many signatures and are moved once.
    rows = rows.withColumns({"_l": F.min("label").over(same), "_h": F.max("label").over(same), "_head": F.min("node").over(same)}).filter("_l < _h")
    rows = rows.select("_head", "node", "label", "size").distinct()
    there = Window.partitionBy("_head")
    rows = rows.withColumns({"_many": F.count("*").over(there), "_all": F.sum("size").over(there)})
    rows = rows.withColumn("_parts", F.greatest(F.ceil(F.col("_many") / MEET), F.ceil(F.col("_all") / MEET_FEATURES))).withColumn("_part", F.pmod(F.xxhash64("node"), "_parts"))
    part = F.col("_part")
    tasks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1), lambda other: F.struct(
        F.xxhash64("_head", F.least(part, other), F.greatest(part, other)).alias("task"), F.when(part == other, 0).when(part < other, 1).otherwise(2).alias("side")))
    return rows.select("node", "label", "size", tasks.alias("_tasks")).groupBy("node", "label", "size").agg(F.flatten(F.collect_list("_tasks")).alias("meets"))


def _tasks(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(members)`` of each task's rows, without their first column ``task``."""
    def each(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        for (task,), members in _groups(batches, 1):
            columns = run(task, members)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return cut_and_free(rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task", "side", "node").mapInArrow(each, schema))


def _hits(rows: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """``a``, ``b``, ``task``, ``more``: of the pairs that sketches do not rule out a few that connect the classes of a task."""
    def run(task, members):
        side, nodes, labels, sizes, sketches = zip(*members)
        nodes, labels = np.array(nodes), np.array(labels)
        i, j, more = nearest(close_pieces(np.array(sizes), labels, list(sketches), np.array(side) if side[0] else None, num, den), labels, limit)
        return np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j]), np.full(len(i), task), more

    return _tasks(rows, run, "a bigint, b bigint, task bigint, more boolean")


def _joined(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect the classes of a task that have similar sets."""
    def near(task, members):
        side, nodes, labels, sizes, sketches = zip(*members)
        labels, some = np.array(labels), np.zeros(len(nodes), bool)
        for i, j, _ in close_pieces(np.array(sizes), labels, list(sketches), np.array(side) if side[0] else None, num, den):
            some[i] = some[j] = True
        return np.full(some.sum(), task), np.array(side)[some], np.array(nodes)[some], labels[some]

    def run(task, members):
        side, nodes, labels, features = zip(*members)
        found = joining([np.frombuffer(f, np.uint64) for f in features], np.array(labels), np.array(side), num, den)
        return [nodes[i] for i, _ in found], [nodes[j] for _, j in found]

    sides = _tasks(rows, near, "task bigint, side bigint, node bigint, label bigint")
    return _waves(sides, sets, lambda wave: _tasks(wave.select("task", "side", "node", "label", "features"), run, "a bigint, b bigint"))


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect those of the pairs that are similar."""
    def across(task, members):
        side = [[m for m in members if m[0] == k] for k in (0, 1)]
        nodes = [m[1] for m in side[0] + side[1]]
        sets = [[np.frombuffer(m[2], np.uint64) for m in s] for s in side]
        found = spanning(nodes, ((i, j + len(side[0])) for i, j in similar_pairs(sets[0], sets[1], num, den)))
        return [a for a, _ in found], [b for _, b in found]

    crowd = pairs.groupBy("a").agg(F.count("*").alias("_many"))
    tasks = cut_and_free(pairs.join(crowd, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("_many") / BLOCK))).alias("task")))
    sides = tasks.select("task", F.lit(0).alias("side"), F.col("a").alias("node")).distinct().unionByName(tasks.select("task", F.lit(1).alias("side"), F.col("b").alias("node")))
    return _waves(sides, sets, lambda wave: _tasks(wave.select("task", "side", "node", "features"), across, "a bigint, b bigint"))


def _waves(sides: DataFrame, sets: DataFrame, run) -> DataFrame:
    """``run`` of the rows with their sets. A set is moved for every task it is in; waves keep what lies on the disks within a multiple of the sets themselves."""
    moved = sides.join(sets.select("node", "size"), "node").agg(F.sum("size")).first()[0] or 0
    waves = max(1, -(-moved // (WAVE * (sets.agg(F.sum("size")).first()[0] or 1))))
    links = None
    for i in range(waves):
        found = run(sides.filter(F.pmod("task", F.lit(waves)) == i).join(sets.select("node", "features"), "node"))
        links = found if links is None else links.unionByName(found)
    return links


def classes(df: DataFrame, n=5, num=80, den=100, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` for every document; similar: ``den * common >= num * union``.

    Null texts and texts without words have an empty set and are linked with
    nothing. Rows with null ids take part and get the smallest other id of
    their class, null if there is none. Repeated rows, and rows that repeat an
    id with another text, come out as often as they are, each with the class of
    its own text. Sets are told apart by 63-bit digests. Other columns are left out.
    """
    rows, named = _classes(df, n, num, den, id_col, text_col)
    return rows.join(named, "_node", "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id")).alias("component_id"))


def _classes(df: DataFrame, n, num, den, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    """The rows' nodes, and of each node that is no empty set its class: ``_component``, ``_first`` (the row that stands for it), ``_rows``."""
    rows = cut_and_free(nodes_of(df, n, id_col, text_col))
    found = components(links(df, rows, n, num, den, id_col, text_col))
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    own = rows.filter("_n > 0").groupBy("_node").agg(F.min("_id").alias("_low"), F.min(first).alias("_own"), F.count("*").alias("_many"))
    own = cut_and_free(own.join(found.select(F.col("node").alias("_node"), "label"), "_node", "left").withColumn("label", F.coalesce("label", "_node")))
    heads = own.groupBy("label").agg(F.min("_low").alias("_component"), F.min("_own").alias("_first"), F.sum("_many").alias("_rows"))
    return rows, own.join(heads, "label").select("_node", "_component", "_first", "_rows")


def keep_one(df: DataFrame, n=5, num=80, den=100, id_col="doc_id", text_col="text") -> DataFrame:
    """``df`` with one row of each class: that of the smallest id, a null id last, and of one id that of the smallest hash of its text.

    Rows are told apart by id and text: rows that repeat an id with another
    text have classes of their own, rows alike in both are one and any of them
    stays. Texts without words are in no class; all of them stay.
    """
    rows, named = _classes(df, n, num, den, id_col, text_col)
    crowded = named.filter("_rows > 1").select("_node", "_rows", F.col("_first.id").alias("_best"), F.col("_first.hash").alias("_best_hash"))
    best = F.col("_id").eqNullSafe(F.col("_best")) & (F.col("_hash") == F.col("_best_hash"))
    found = cut_and_free(rows.filter("_n > 0").join(crowded, "_node").select(F.col("_id").alias("_key"), F.col("_hash").alias("_key_hash"), best.alias("_best"))
                        .groupBy("_key", "_key_hash", "_best").agg(F.count("*").alias("_copies")))
    same = lambda other: df[id_col].eqNullSafe(other["_key"]) & (_hash(text_col) == other["_key_hash"])
    gone = small_side(cut_and_free(found.filter("not _best").select("_key", "_key_hash")))
    kept = df.join(gone, same(gone), "left_anti")
    twice = cut_and_free(found.filter("_best and _copies > 1").select("_key", "_key_hash"))
    if twice.isEmpty():
        return kept
    twice = small_side(twice)
    repeated = kept.join(twice, same(twice)).select(F.struct(*(kept[c] for c in kept.columns)).alias("_row"), twice["_key"].alias("_a"), twice["_key_hash"].alias("_b")) \
        .dropDuplicates(["_a", "_b"])
    return kept.join(twice, same(twice), "left_anti").unionByName(repeated.select("_row.*"))
