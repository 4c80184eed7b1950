"""Exact duplicates, k-means and fill-in-middle against plain versions, with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from colloquy.llm import exact, middle, shallot

TEXT = "_id bigint, _text string, _hash string, _row int, _size int"     # names that the operators use themselves


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# Exact duplicates


def plain_classes(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), key is None, key or 0, key))
    found = []
    for text, own in groups.items():
        own.sort()
        for place, row in enumerate(own):
            found.append((row[3], own[0][3], len(own), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


def odd_texts():
    rng = random.Random(1)
    words = ["a", "b", "Ä", "\U0001f600", "\x85", "\xa0"]
    made = [(i, rng.choice(["", " ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(300)]
    long = "lorem ipsum " * 20_000
    return made + [(5, made[7][1])] * 40 + [(None, "a"), (None, None), (None, "a b"), (900, None), (901, " \t\r"), (902, long), (903, long + " "),
                                            (904, long[:-2] + "n"), (-3, "xx y"), (3000, "x  xy"), (3001, "x xy")]


@pytest.mark.parametrize("cells", [1_000_000, 0])
def test_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", cells)
    data = odd_texts()
    df = spark.createDataFrame([(k, t, "h", 1, 2) for k, t in data], TEXT)
    columns = ("_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(exact.classes(df, "_id", "_text", hash_all=True), *columns) == plain_classes(data)
    some = rows_of(exact.classes(df, "_id", "_text"), *columns)
    assert [r[:4] for r in some] == sorted((r[:4] for r in plain_classes(data)), key=repr)
    assert any(r[4] is None for r in some) and all(r[4] for r in some if r[2] > 1)
    kept = exact.keep(df, "_id", "_text")
    assert kept.columns == df.columns
    assert rows_of(kept, "_id") == sorted(((r[0],) for r in plain_classes(data) if r[3]), key=repr)


def test_exact_edges(spark):
    empty = spark.createDataFrame([], TEXT)
    assert exact.classes(empty, "_id", "_text").count() == 0 and exact.keep(empty, "_id", "_text").count() == 0
    names = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", " x"), ("d", "y")], "name string, body string")
    assert rows_of(exact.classes(names, "name", "body"), "name", "keep_id", "kept")[0] == ("a", "a", True)
    # Two thirds of all rows are one text: its group is joined by broadcast, copies come out one by one.
    many = spark.range(200_000).selectExpr("if(id < 70000, 1, id) as doc_id", "if(id % 3 > 0, 'same text', concat('t', id)) as text")
    found = exact.classes(many)
    assert found.count() == 200_000 and found.filter("kept").count() == 66_667 + 1
    assert found.filter("text_sha256 is not null and group_size > 1").agg({"group_size": "max"}).first()[0] == 133_333


def test_exact_plan_is_native(spark):
    plan = exact.classes(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# k-means


def plain_kmeans(rows, k, rounds, dims, scale=1024):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    heads = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    places = [v for _, v in heads]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(places))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        places = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(places)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = defaultdict(int)
    for _, j, d in found:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, places[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("seed, dims, k, high", [(1, 2, 8, 0.01), (2, 3, 5, 3), (3, 4, 8, 150_000), (4, 1, 8, 0.004), (5, 2, 1, 1)])
def test_kmeans(spark, seed, dims, k, high):
    """Few distinct components make ties; large ones are beyond 64 bits while they are summed up."""
    rng = random.Random(seed)
    rows = [(i, [round(rng.uniform(-high, high) * 1024) / 1024 if seed < 3 else rng.uniform(-high, high) for _ in range(dims)]) for i in range(400)]
    rows += [rows[5]] * 3 + [(None, rows[7][1]), (None, None), (800, []), (801, [None] * dims), (802, [float("nan")] * dims),
                             (803, [float("inf")] * dims), (804, [0.0] * (dims + 1))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, state string, ids int").repartition(3)
    got = rows_of(shallot.cluster(df, k=k, rounds=6, dims=dims), *COLUMNS)
    assert got == plain_kmeans(rows, k, 6, dims)


def test_kmeans_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert shallot.cluster(spark.createDataFrame([], schema), dims=2).count() == 0
    assert shallot.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema), dims=2).count() == 0
    few = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.5, 0.0])]
    assert rows_of(shallot.cluster(spark.createDataFrame(few, schema), dims=2), *COLUMNS) == plain_kmeans(few, 8, 10, 2)


def test_kmeans_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0])], "vec_id bigint, embedding array<double>")
    assert {r.distance for r in shallot.cluster(df, dims=2).collect()} == {0}
    with pytest.raises(Exception, match="Overflow|too large|too big"):
        shallot.cluster(df, k=1, dims=2).collect()


def test_search_equals_measuring_every_centroid():
    rng = np.random.default_rng(3)
    for trial in range(20):
        k, dims = int(rng.integers(2, 30)), int(rng.integers(1, 6))
        vectors = rng.integers(-12, 13, (500, dims))
        places = rng.integers(-12, 13, (k, dims)).tolist()
        ground = shallot.Ground(places, None)
        state, measured = shallot.begin(vectors, ground), 0
        for _ in range(6):
            new = (np.array(places) + rng.integers(-1, 2, (k, dims)) * (rng.random((k, 1)) < 0.5)).tolist()
            ground, places = shallot.Ground(new, places), new
            state = shallot.search(vectors, *state, ground)
            every = np.stack([shallot.squared(vectors, c) for c in np.array(places)], axis=1)
            assert (state[0] == every.argmin(axis=1)).all()
            true = np.sqrt(every)
            assert (state[2] >= true[np.arange(500), state[0]]).all()
            rest = np.where(np.arange(k) == state[0][:, None], np.inf, true)
            assert (state[3] <= rest.min(axis=1)).all()


# Fill-in-middle


def plain_middle(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_texts():
    rng = random.Random(2)
    alphabet = ["word", "Xy", " ", "\n", "é", "9", "\U0001f600", "<", ">", "P", "<P", "S>", ""]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))) for i in range(400)]
    return rows + [(500, "a" * 100_000), (501, "ab, " * 80_000), (502, "é" * 1_500_000 + "word " * 200_000), (503, "z" * (middle.BLOCK + 5) + " q"), (504, "<M>"),
                   (None, None), (None, "some text"), (None, "some text"), (None, "other"), (505, ""), (6, "again"), (6, "again"), (6, "other one")]


def test_middle(spark):
    rows = middle_texts()
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in rows], "doc_id bigint, text string, output string, n int").repartition(5)
    expected = []
    for key, text in rows:
        *row, output = plain_middle(key, text)
        expected.append((*row, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, text or "")), output, text or ""))
        assert middle.restore(output, row[2]) == (text or "")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "restored"]
    assert rows_of(middle.transform(df, texts=True), *names) == sorted(expected, key=repr)
    assert rows_of(middle.transform(df, parts=3), *names[:7]) == sorted((e[:7] for e in expected), key=repr)


def test_middle_edges(spark):
    assert middle.transform(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    named = spark.createDataFrame([("k7", "one two"), ("", "three")], "name string, body string")
    assert [r[:6] for r in rows_of(middle.transform(named, "name", "body", texts=True), "name", "n", "form", "prefix_chars", "middle_chars", "output")] \
        == sorted((plain_middle(k, t) for k, t in (("k7", "one two"), ("", "three"))), key=repr)


def test_middle_of_one_text_repeated(spark):
    """Equal rows are spread over as many groups as there were tasks that read them."""
    df = spark.range(0, 3000, 1, 6).selectExpr("1L as doc_id", "'the same text, again' as text")
    assert middle.transform(df).groupBy("doc_id", "form").count().collect()[0]["count"] == 3000
    assert middle.sorted_pieces(df).filter("place = 0").select("document").distinct().count() == 6
