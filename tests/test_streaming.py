"""Streams in several drops give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators.firing import analysis_fires
from colloquy.operators.novelty import suppress_repeats
from colloquy.schemas import FEED
from colloquy.streaming.findings import live_survivors
from colloquy.streaming.gaps import live_segments
from colloquy.streaming.runs import for_each_batch, run_to_table
from colloquy.streaming.triggers import live_fires


def _feed():
    rows, long = [], "one two three four five six seven eight nine ten"
    for m in (1, 2, 3):
        for seq in range(40):
            if seq % 13 == 5:
                rows.append((m, seq, "analyze_now", None, None, None))
            elif seq == 20:
                rows.append((m, seq, "set_threshold", None, None, 15))
            else:
                rows.append((m, seq, "segment", " ".join(long.split()[: 1 + (seq * m) % 9]), m != 3 or seq > 30, None))
    rows.append((4, 0, "analyze_now", None, None, None))
    return rows


def _drop(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("drops", [1, 3])
def test_live_fires_equal_batch(spark, tmp_path, drops):
    rows = _feed()
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for d in range(drops):
        part = [r for r in rows if r[1] * drops // 40 == d]
        _drop(spark, part, FEED, source)
        stream = spark.readStream.schema(FEED).parquet(source)
        run_to_table(live_fires(stream, 25, 60), out, check)
    columns = ["meeting_id", "seq", "fire_no", "kind", "since", "total", "summary_fired"]
    live = spark.read.parquet(out)
    assert live.filter("kind = 'empty'").count() == 1
    assert live.filter("kind = 'late'").count() == 0
    batch = analysis_fires(spark.createDataFrame(rows, FEED), 25, 60)
    got = live.filter("kind <> 'empty'").select(columns).collect()
    want = batch.select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_late_rows_change_nothing(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for rows in ([(1, 1, "segment", "a b c", True, None)], [(1, 0, "segment", "x y z", True, None)],
                 [(1, 2, "segment", "d e", True, None)]):
        _drop(spark, rows, FEED, source)
        run_to_table(live_fires(spark.readStream.schema(FEED).parquet(source), 5), out, check)
    rows = {(r.seq, r.kind, r.total, r.recent, r.text) for r in spark.read.parquet(out).collect()}
    assert rows == {(0, "late", None, None, "x y z"), (2, "incremental", 5, "a b c d e", None)}


def test_stop_and_clear_end_the_state(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    first = [(m, i, "segment", "a b c", True, None) for m in (1, 2, 3) for i in range(2)]
    again = [(m, i, "segment", "d e f", True, None) for m in (1, 2, 3) for i in range(2)]
    for rows in (first + [(1, 2, "stop", None, None, None), (2, 2, "clear", None, None, None)], again):
        _drop(spark, rows, FEED, source)
        run_to_table(live_fires(spark.readStream.schema(FEED).parquet(source), 5), out, check)
    rows = sorted((r.meeting_id, r.kind, r.total or 0) for r in spark.read.parquet(out).collect())
    assert rows == [(1, "final", 6), (1, "incremental", 6), (1, "incremental", 6), (2, "incremental", 6), (2, "incremental", 6),
                    (3, "incremental", 6), (3, "late", 0), (3, "late", 0)]


def test_live_survivors_equal_batch(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = ("meeting_id bigint, fire_no bigint, is_error boolean, result struct<potential_issues:array<string>,"
              "recommendations:array<string>>")
    rows = [(1, i, False, ([f"Issue {i % 7}", f"open PORT {i}"], [f"do {i % 12}"])) for i in range(1, 41)]
    for part in (rows[:13], rows[13:]):
        _drop(spark, part, schema, source)
        run_to_table(live_survivors(spark.readStream.schema(schema).parquet(source)), out, check)
    got = {(r.kind, r.fire_no): list(r["items"]) for r in spark.read.parquet(out).collect()}
    table = spark.createDataFrame(rows, schema)
    for kind in ("potential_issues", "recommendations"):
        batch = suppress_repeats(table.select("meeting_id", "fire_no", F.col(f"result.{kind}").alias("items")),
                                 ["meeting_id"], "fire_no", "items")
        for r in batch.collect():
            assert got[(kind, r.fire_no)] == list(r["items"])


def test_live_gap_segments(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    base = 1_700_000_000_000
    points = [(1, base + ms, s) for ms, s in
              ((0, .9), (500, .8), (1200, .7), (1500, .1), (1901, .9), (2601, .9), (200_000, .9), (400_000, .9))]
    frame = spark.createDataFrame(points, "stream bigint, ms bigint, score double").select(
        "stream", F.timestamp_millis("ms").alias("ts"), "score")
    frame.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    run_to_table(live_segments(stream, ["stream"], "ts", "score"), out, check)
    got = spark.read.parquet(out).select(
        (F.unix_millis("start") - base).alias("s"), (F.unix_millis("end") - base).alias("e"), "points").collect()
    assert sorted(map(tuple, got))[:2] == [(-300, 1200, 3), (1601, 2601, 2)]


def test_hook_sees_every_segment_once(spark, tmp_path):
    source, check, seen = str(tmp_path / "in"), str(tmp_path / "check"), []
    for rows in ([(1, 0, "a")], [(1, 1, "b"), (2, 0, "c")]):
        _drop(spark, rows, "meeting_id bigint, seq bigint, text string", source)
        stream = spark.readStream.schema("meeting_id bigint, seq bigint, text string").parquet(source)
        for_each_batch(stream, lambda batch, _: seen.extend(r.text for r in batch.collect()), check)
    assert sorted(seen) == ["a", "b", "c"]
