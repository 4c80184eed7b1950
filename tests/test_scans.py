"""Order-dependent operators against plain Python, with blocks of every size."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from colloquy.operators.blocks import position_faults, top_of
from colloquy.operators.budget import kept_phases, kept_ranges
from colloquy.operators.chunker import chunk_members, overlapping_chunks
from colloquy.operators.gaps import active_segments
from colloquy.operators.history import meeting_tails, recent_at, tail_at, transcript, with_totals
from colloquy.operators.novelty import suppress_repeats
from colloquy.operators.running import with_position, with_running
from colloquy.operators.trigger import NEVER, _apply, block_effect, chain_effects, reset_trigger
from pyspark.sql import functions as F

SIZES = [dict(top=10), dict(bits=1, super_bits=1), dict(bits=2, super_bits=3, top=63), dict(bits=10, super_bits=12)]


def _run(sizes, limits, state, reset):
    fires = 0
    for size, limit in zip(sizes, limits):
        state += size
        if state >= limit:
            state, fires = reset, fires + 1
    return state, fires


steps = st.lists(st.tuples(st.integers(0, 6), st.sampled_from([10, 10, 7, 0, NEVER])), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(steps, steps, st.sampled_from([0, 3]), st.integers(0, 30))
def test_block_effects(first, second, reset, state):
    a, b = ([list(x) for x in zip(*rows)] for rows in (first, second))
    one = block_effect(*a, reset)
    assert _apply(*one, state) == _run(*a, state, reset)
    both = chain_effects(one, block_effect(*b, reset))
    assert _apply(*both, state) == _run(a[0] + b[0], a[1] + b[1], state, reset)


@pytest.mark.parametrize("blocks", SIZES)
def test_running(spark, blocks):
    rng = random.Random(3)
    rows = [(k, i * 3 if k == 2 else i, rng.choice([None, 1, 5, 9])) for k in range(4) for i in range(4 if "top" in blocks and "bits" not in blocks else 17)]
    df = spark.createDataFrame(rows, "k int, i bigint, v bigint")
    out = with_running(df, ["k"], "i", {"s": ("sum", "v"), "m": ("max", "v"), "last": ("last", "v")}, inclusive=False, **blocks)
    back = with_running(df, ["k"], "i", {"s": ("sum", "v"), "last": ("last", "v")}, reverse=True, **blocks)
    pos = {(r.k, r.i): r.pos for r in with_position(df, ["k"], "i", **blocks).collect()}
    got = {(r.k, r.i): (r.s, r.m, r["last"]) for r in out.collect()}
    got_back = {(r.k, r.i): (r.s, r["last"]) for r in back.collect()}
    for k in range(4):
        mine = sorted(r for r in rows if r[0] == k)
        for n, (_, i, v) in enumerate(mine):
            before = [r[2] for r in mine[:n] if r[2] is not None]
            after = [r[2] for r in mine[n:] if r[2] is not None]
            assert pos[(k, i)] == n
            assert got[(k, i)] == (sum(before) if before else None, max(before, default=None), before[-1] if before else None)
            assert got_back[(k, i)] == (sum(after) if after else None, after[0] if after else None)


@pytest.mark.parametrize("blocks", SIZES)
@pytest.mark.parametrize("reset", [0, 4])
def test_trigger(spark, blocks, reset):
    rng = random.Random(7)
    rows = [(k, i, rng.randint(0, 5), rng.choice([12, 12, 12, 0, None]), f"{k}-{i}")
            for k in range(3) for i in range(8 if blocks == dict(top=10) else 60)]
    df = spark.createDataFrame(rows, "k int, i bigint, n bigint, l bigint, t string")
    run = reset_trigger(df, ["k"], "i", "n", "l", extras=["t"], reset=reset, lookback=2, **blocks)
    got = sorted((r.k, r.i, r.fire_no, r.since, r.total, [x.t for x in r.recent]) for r in run.fires(3).collect())
    flags = {(r.k, r.i): r.fired for r in run.rows().collect()}
    ends = {r.k: (r.since, r.total, r.fires) for r in run.final().collect()}
    want = []
    for k in range(3):
        state = total = fires = 0
        for i, (_, _, n, limit, _) in enumerate(r for r in rows if r[0] == k):
            state, total = state + n, total + n
            hit = limit is not None and state >= limit and (limit > 0 or total > 0)
            assert flags[(k, i)] == hit
            if hit:
                fires += 1
                want.append((k, i, fires, state, total, [f"{k}-{j}" for j in range(max(0, i - 2), i + 1)]))
                state = reset
        assert ends[k] == (state, total, fires)
    assert got == want


def test_long_meeting_with_default_blocks(spark):
    """One meeting of 5,000 rows (five blocks) beside short ones; unit sizes never fall into step."""
    rows = [(0, i, 1 if i % 2 else 3) for i in range(5000)] + [(k, i, 1) for k in range(1, 4) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, i bigint, n bigint").repartition(3)
    run = reset_trigger(df, ["k"], "i", "n", 201, top=top_of(df, "i"))
    got = sorted((r.k, r.i, r.fire_no, r.total) for r in run.fires().collect())
    want, state, total = [], 0, 0
    for _, i, n in rows[:5000]:
        state, total = state + n, total + n
        if state >= 201:
            want.append((0, i, len(want) + 1, total))
            state = 0
    assert got == want and len(want) > 40
    assert {r.k: r.total for r in run.final().collect()} == {0: 10000, 1: 30, 2: 30, 3: 30}


def _sift(lists, window=10):
    seen, out = [], []
    for items in lists:
        kept = [i for i in items if not any(i.lower() in p.lower() or p.lower() in i.lower() for p in seen[-window:])]
        seen += kept
        out.append(kept)
    return out


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_novelty(spark, bits):
    rng = random.Random(5)
    word = lambda: rng.choice(["Port", "port 2", "disk", "DISK full", "zone", "a", "b", "key", "keys", "log", "tls", "dns", "vm", ""])
    lists = {k: [[f"{word()}{rng.choice(['', ' x', rng.randint(0, 40)])}" for _ in range(rng.randint(0, 3))] for _ in range(40)] for k in (1, 2)}
    df = spark.createDataFrame([(k, i, v) for k, ls in lists.items() for i, v in enumerate(ls)], "k int, i bigint, items array<string>")
    got = {(r.k, r.i): list(r["items"]) for r in suppress_repeats(df, ["k"], "i", "items", bits=bits, super_bits=1).collect()}
    for k, ls in lists.items():
        assert [got[(k, i)] for i in range(40)] == _sift(ls)
    assert sum(map(len, got.values())) < sum(len(v) for ls in lists.values() for v in ls)


def test_novelty_window_edges(spark):
    distinct = [[f"item number {c}"] for c in "abcdefghijk"]
    tenth, eleventh = [["ITEM NUMBER B"]], [["item number a"]]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(distinct + tenth + eleventh + [["same", "same"], [""]])],
                               "k int, i bigint, items array<string>")
    got = [list(r["items"]) for r in suppress_repeats(df, ["k"], "i", "items").orderBy("i").collect()]
    assert got[11] == [] and got[12] == ["item number a"] and got[13] == ["same", "same"] and got[14] == []
    alone = spark.createDataFrame([(1, 0, [""])], "k int, i bigint, items array<string>")
    assert list(suppress_repeats(alone, ["k"], "i", "items").first()["items"]) == [""]


@pytest.mark.parametrize("blocks", [{}, dict(bits=1, super_bits=1)])
def test_kept_summaries(spark, blocks):
    rng = random.Random(2)
    counts = {1: [400, 400, 400], 2: [1001], 3: [0, 500, 0, 500, 0, 1], 4: [rng.choice([0, 100, 300, 999, 1000, 1001]) for _ in range(25)],
              5: [0] * 6, 6: [1000, 0, 1]}
    rows = [(m, i, " ".join(["w"] * n)) for m, ns in counts.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "meeting_id bigint, summary_seq bigint, text string")
    ranges = kept_ranges(df, top=None if blocks else 25, **blocks)
    got = {(r.meeting_id, r.idx): (r.first_kept, r.kept) for r in ranges.collect()}
    phases = {}
    for r in kept_phases(ranges).collect():
        phases.setdefault((r.meeting_id, r.idx), []).append((r.phase, len(r.phase_text.split())))
    for m, ns in counts.items():
        kept = []
        for i, n in enumerate(ns):
            kept.append((i, n))
            while sum(k[1] for k in kept) > 1000:
                kept.pop(0)
            assert got[(m, i)] == (kept[0][0] if kept else i + 1, len(kept)), (m, i)
            assert sorted(phases.get((m, i), [])) == [(p + 1, k[1]) for p, k in enumerate(kept)]


def test_chunks_of_samples(spark):
    df = spark.createDataFrame([(1, i, 8192) for i in range(8)], "meeting_id bigint, seq bigint, n bigint")
    got = overlapping_chunks(df, ["meeting_id"], "seq", "n").orderBy("chunk_no").collect()
    assert [(r.end - r.start, r.flushed) for r in got] == [(32768, False)] + [(32192, False)] * 4 + [(24000, True)]
    assert got[4].end == 8 * 8192
    fresh = overlapping_chunks(df, ["meeting_id"], "seq", "n", flush_only_new=True)
    assert fresh.filter("flushed").count() == 0
    short = spark.createDataFrame([(1, 0, 16001), (2, 0, 16000)], "meeting_id bigint, seq bigint, n bigint")
    assert [(r.meeting_id, r.end) for r in overlapping_chunks(short, ["meeting_id"], "seq", "n").collect()] == [(1, 16001)]
    members = chunk_members(df, overlapping_chunks(df, ["meeting_id"], "seq", "n"), ["meeting_id"], "seq", "n")
    want = sorted((r.chunk_no, i) for r in got for i in range(8) if i * 8192 < r.end and r.start < (i + 1) * 8192)
    assert sorted((r.chunk_no, r.seq) for r in members.collect()) == want


@pytest.mark.parametrize("n", [3, 7])
def test_tails_and_recent(spark, n):
    rng = random.Random(n)
    texts = {m: [" ".join(f"w{m}.{i}.{j}" for j in range(rng.randint(1, 6))) for i in range(30)] for m in (1, 2)}
    rows = [(m, i, t) for m, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "meeting_id bigint, seq bigint, text string")
    totals = with_totals(df)
    points = totals.select("meeting_id", F.col("seq").alias("seg_pos"), "total")
    out = recent_at(df, tail_at(totals, points, n, block_words=8), 4, bits=2)
    for r in out.collect():
        heard = texts[r.meeting_id][: r.seg_pos + 1]
        words = " ".join(heard).split()
        assert r.total == len(words)
        assert r.tail == (" ".join(words[-n:]) if len(words) > n else " ".join(heard))
        assert r.recent == " ".join(heard[-4:])
    parts = transcript(df, bits=3).orderBy("part").collect()
    assert " ".join(p.text for p in parts if p.meeting_id == 1) == " ".join(texts[1])


def test_short_meetings_take_the_short_way(spark):
    df = spark.createDataFrame([(1, 0, "a  b"), (1, 1, "c d e"), (2, 0, "x")], "meeting_id bigint, seq bigint, text string")
    for top in (None, 5000):
        got = {(r.meeting_id, r.seg_pos, r.total, r.tail) for r in meeting_tails(df, 4, top=top).collect()}
        assert got == {(1, 1, 5, "b c d e"), (2, 0, 1, "x")}
    assert {r.tail for r in meeting_tails(df, 5).collect()} == {"a  b c d e", "x"}


def test_position_faults(spark):
    good = [(1, 0), (1, 1), (1, 2), (2, 0)]
    bad = [(3, 1), (4, 0), (4, 2), (5, 0), (5, 0), (6, 0), (6, 0), (6, 3), (6, 3)]
    df = spark.createDataFrame(good + bad, "k int, i bigint")
    assert {r.k for r in position_faults(df, ["k"], "i").collect()} == {3, 4, 5, 6}


def test_gaps_merge_at_the_silence_itself(spark):
    ms = [0, 700, 1401, 1402, 5000]
    df = spark.createDataFrame([(1, m, .5) for m in ms] + [(1, 600, .4)], "s bigint, ms bigint, score double")
    df = df.select("s", F.timestamp_millis("ms").alias("ts"), "score")
    got = active_segments(df, ["s"], "ts", "score").orderBy("segment_no").select(
        F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b"), "points").collect()
    assert [tuple(r) for r in got] == [(-300, 700, 2), (1101, 1402, 2), (4700, 5000, 1)]
