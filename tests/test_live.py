"""Live meetings against whole-table analyses; calls that are made once; meetings that end."""

import json
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from colloquy.operators.history import recent_at
from colloquy.plans.analysis import analyse, final_analysis, segments_of
from colloquy.plans.contexts import with_parameters
from colloquy.plans.scoring import client_scorer
from colloquy.schemas import FEED
from colloquy.sources.sessions import with_minutes
from colloquy.streaming.ledger import answers, asked_once, score_batches
from colloquy.streaming.meetings import live_calls, live_results
from colloquy.streaming.runs import run_to_table
from colloquy.streaming.triggers import live_fires

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # clients travel with their tasks


def _drop(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _client():
    """Answers depend on the whole prompt; some are no JSON, some lack lists, some calls fail, some summaries are very long."""
    def call(request):
        text = request["user_prompt"]
        mark = sum(map(ord, text)) % 11
        if mark == 0:
            raise ValueError("no answer")
        if request["kind"] == "summary":
            return " ".join(["long"] * (1100 if mark == 1 else 300)) + f" {mark}", None
        if mark == 1:
            return "no JSON", None
        if mark == 2:
            return json.dumps({"potential_issues": "a text"}), None
        return json.dumps({"technical_analysis": f"{len(text)}", "potential_issues": [f"Issue {mark}", text.split()[-1]], "recommendations": [f"do {mark}"]}), None
    return call


def _feed():
    rows, long = [], "one two three four five six seven eight nine ten"
    for m in (1, 2, 3, 5):
        for seq in range(60):
            if seq % 13 == 5:
                rows.append((m, seq, "analyze_now", None, None, None))
            elif seq == 20:
                rows.append((m, seq, "set_threshold", None, None, 15))
            else:
                rows.append((m, seq, "segment", " ".join(f"{w}{m}{seq}" for w in long.split()[: 1 + (seq * m) % 9]) + (" many" * 300 if seq % 17 == 3 else ""), m != 3 or seq > 30, None))
    rows.append((4, 0, "analyze_now", None, None, None))
    return rows


def test_live_meetings_equal_whole_tables(spark, tmp_path):
    rows = _feed()
    source, out, check, ledger = (str(tmp_path / n) for n in ("in", "out", "check", "ledger"))
    stops = [(m, 60, "stop", None, None, None) for m in (1, 2, 3, 5)]
    for part in ([r for r in rows if r[1] < 23], [r for r in rows if r[1] >= 23] + stops):
        _drop(spark, part, FEED, source)
        calls = live_calls(spark.readStream.schema(FEED).parquet(source), asked_once(_client, ledger), 25)
        run_to_table(calls, out, check)
    live = spark.read.parquet(out)
    feed = spark.createDataFrame(rows, FEED)
    run = analyse(feed, client_scorer(_client), 25)
    batch = {(r.meeting_id, r.fire_no): (r.result, r.is_error) for r in run.results.collect()}
    got = live_results(live).filter("kind in ('incremental', 'comprehensive')").collect()
    assert len(got) == len(batch) > 60
    assert [(r.meeting_id, r.fire_no, r.result, batch[r.meeting_id, r.fire_no]) for r in got if batch[r.meeting_id, r.fire_no] != (r.result, r.is_error)] == []
    assert 0 < sum(r.is_error for r in got) < len(got)
    summaries = {(r.meeting_id, r.fire_no): r.response for r in live.filter("kind = 'summary'").collect()}
    assert {k: v for k, v in summaries.items() if v is not None} == {(r.meeting_id, r.summary_seq): r.text for r in run.summaries.collect()}
    # Final analyses know the phases and the number of analyses.
    fires = run.fires.groupBy("meeting_id").agg(F.count("*").alias("analyses"))
    last = run.ranges.groupBy("meeting_id").agg(F.max("idx").alias("idx"))
    from colloquy.operators.budget import kept_phases, phase_blocks
    phases = phase_blocks(kept_phases(run.ranges)).join(last, ["meeting_id", "idx"]).select("meeting_id", "phases")
    final = {r.meeting_id: (r.result, r.is_error, r.retried) for r in
             final_analysis(segments_of(feed), client_scorer(_client), analyses=fires, phases=phases).collect()}
    done = {r.meeting_id: (r.result, r.is_error, r.retried) for r in live_results(live).filter("kind = 'final'").collect()}
    assert done == final and len(done) == 4
    assert [(r.meeting_id, r.error) for r in live.filter("kind = 'empty'").collect()] == [(4, "No transcript to analyze yet")]


def test_a_restarted_batch_asks_nothing_twice(spark, tmp_path):
    """The first attempt dies in the middle of a task and loses its offsets' commit; the second finishes it."""
    source, folder, check, counted = (str(tmp_path / n) for n in ("in", "out", "check", "counted"))
    Path(counted).mkdir()
    rows = [(1, i, "summary" if i % 2 else "final", f"text {i}") for i in range(40)]
    schema = "meeting_id bigint, fire_no bigint, kind string, user_prompt string"

    def make(dies):
        def client():
            def call(request):
                if dies and request["fire_no"] == 23:
                    raise SystemExit("the executor is lost")    # no model error: the task itself dies
                with open(f"{counted}/{request['fire_no']}", "a") as file:
                    file.write("x")
                if request["fire_no"] == 7:
                    raise ValueError("refused")
                return f"answer {request['fire_no']}", {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}
            return call
        return client

    _drop(spark, rows, schema, source)
    stream = lambda: with_parameters(spark.readStream.schema(schema).parquet(source))
    with pytest.raises(Exception):
        score_batches(stream(), make(True), folder, check)
    before = len(list(Path(counted).iterdir()))
    assert 0 < before < 40
    score_batches(stream(), make(False), folder, check)
    assert {len(p.read_text()) for p in Path(counted).iterdir()} == {1} and len(list(Path(counted).iterdir())) == 40
    got = answers(spark, folder).collect()
    assert sorted(r.fire_no for r in got) == list(range(40)) and {r.batch for r in got} == {0}
    assert [(r.fire_no, r.error) for r in got if r.error] == [(7, "refused")]
    # The same rows in a batch whose commit was lost: its folder is written anew, nothing is asked.
    (Path(check) / "commits" / "0").unlink()
    (Path(check) / "commits" / ".0.crc").unlink(missing_ok=True)
    score_batches(stream(), make(False), folder, check)
    assert answers(spark, folder).count() == 40 and {len(p.read_text()) for p in Path(counted).iterdir()} == {1}


def test_silence_ends_a_meeting_and_its_state(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    heard = [(m, i, "segment", "a b c", True, None) for m in (1, 2) for i in range(3)]
    parts = [heard, [(9, 0, "set_threshold", None, None, 50)],
             [(1, 500, "segment", "far too late", True, None), (2, 0, "segment", "d e f g h", True, None)]]
    for part in parts:
        if part is not heard:
            time.sleep(1.5)
        _drop(spark, part, FEED, source)
        run_to_table(live_fires(spark.readStream.schema(FEED).parquet(source), 5, idle_ms=1000), out, check)
        if part is parts[1]:
            state = spark.read.format("statestore").option("stateVarName", "meeting").load(check)
            assert [r[0].meeting_id for r in state.select("key").collect()] == [9]
    rows = sorted((r.meeting_id, r.kind, r.total or 0) for r in spark.read.parquet(out).collect() if r.meeting_id != 9)
    # A late row opens nothing; position 0 begins the meeting again.
    assert rows == [(1, "final", 9), (1, "incremental", 6), (1, "late", 0), (2, "final", 9), (2, "incremental", 5), (2, "incremental", 6)]


def test_minutes_of_a_feed(spark):
    feed = spark.createDataFrame([(1, 0, 1000), (1, 1, 1179), (1, 2, 900), (2, 0, 5)], "meeting_id bigint, seq bigint, s bigint") \
        .withColumn("ts", F.timestamp_seconds("s"))
    sessions = spark.createDataFrame([(1, 1000), (1, 2000)], "meeting_id bigint, s bigint").select("meeting_id", F.timestamp_seconds("s").alias("start_time"))
    got = {(r.meeting_id, r.seq): r.minutes for r in with_minutes(feed, sessions).collect()}
    assert got == {(1, 0): 0, (1, 1): 2, (1, 2): 0, (2, 0): None}


def test_positions_with_gaps_are_an_error(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in [*range(1020), 1030]], "meeting_id bigint, seq bigint, text string")
    points = spark.createDataFrame([(1, 1030)], "meeting_id bigint, seg_pos bigint")
    with pytest.raises(Exception, match="have gaps"):
        recent_at(rows, points, 3).collect()
    dense = spark.createDataFrame([(1, i, f"t{i}") for i in range(1031)], "meeting_id bigint, seq bigint, text string")
    assert recent_at(dense, points, 3).collect()[0].recent == "t1028 t1029 t1030"


class Counted:
    """A state variable that counts calls."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_a_meeting_without_a_fire_costs_two_calls_of_the_store():
    import pandas as pd
    from colloquy.streaming.triggers import WordTrigger

    calls = []
    trigger = WordTrigger(threshold=5)
    trigger.handle, trigger.state, trigger.marker = None, Counted(calls), Counted(calls)

    def drop(*rows):
        names = ["meeting_id", "seq", "event", "text", "auto", "value", "n_words", "epoch", "minutes"]
        parts = [pd.DataFrame([(1, seq, event, text, True, 0, len(text.split()), 0, 0)], columns=names) for seq, event, text in rows]
        return [tuple(r) for frame in trigger.handleInputRows((1,), iter(parts), None) for r in frame[["seq", "kind", "total"]].itertuples(index=False)]

    assert drop((1, "segment", "c d"), (0, "segment", "a b")) == []
    assert len(calls) <= 3
    calls.clear()
    names = ["meeting_id", "seq", "event", "text", "auto", "value", "n_words", "epoch", "minutes"]
    frames = list(trigger.handleInputRows((1,), iter([pd.DataFrame([(1, 2, "set_threshold", "", True, 6, 0, 0, 0)], columns=names)]), None))
    assert frames == [] and calls == ["get", "update"]
    assert drop((4, "segment", "g h"), (3, "segment", "e f")) == [(3, "incremental", 6)]
    assert drop((5, "stop", "")) == [(5, "final", 8)]
    assert [r[:2] for r in drop((6, "segment", "late"))] == [(6, "late")] and trigger.marker.value == (5, -1)
    assert drop((0, "segment", "a b c d e f g")) == [(0, "incremental", 7)]
    assert trigger.marker.value is None and trigger.state.value[0] == 0
