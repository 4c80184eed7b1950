"""Meetings end to end: firing, contexts, responses, rules, sources."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from colloquy.fixed_values import LIST_FIELDS
from colloquy.functions.responses import findings, latest, parse_responses, report_lines, shown_result
from colloquy.operators import firing, stats
from colloquy.plans import analysis, rules, scoring
from colloquy.schemas import FEED, SEGMENTS
from colloquy.sources import realtime, sessions
from colloquy.sources.segment_log import SegmentLog

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-in model runs in workers

FULL = {"technical_analysis": "t", "potential_issues": ["a"], "recommendations": ["b"], "clarifying_questions": ["c"], "action_items": ["d"]}


def without(*keys, **more):
    return json.dumps({**{k: v for k, v in FULL.items() if k not in keys}, **more})


CASES = [  # response, live result or None for an error, final result or None
    (json.dumps(FULL), FULL, FULL),
    (without("potential_issues", "action_items"), {**FULL, "potential_issues": [], "action_items": []}, {**FULL, "potential_issues": [], "action_items": []}),
    (without("technical_analysis"), {**FULL, "technical_analysis": "No technical discussion detected yet"},
     {**FULL, "technical_analysis": "No technical analysis available"}),
    ("not json", None, None), ("[1]", None, None), ("", None, None), (None, None, None), ('"x"', None, None), ("null", None, None),
    (json.dumps(FULL) + " and more", None, None),
    (without(potential_issues=None), None, {**FULL, "potential_issues": None}),
    (without(recommendations=["b", 1]), None, {**FULL, "recommendations": ["b", "1"]}),
    (without(recommendations=["b", None]), None, {**FULL, "recommendations": ["b", None]}),
    (without(clarifying_questions=None, technical_analysis=None), {**FULL, "clarifying_questions": None, "technical_analysis": None},
     {**FULL, "clarifying_questions": None, "technical_analysis": None}),
    (without(action_items="one"), None, None), (without(potential_issues="one"), None, None),
    (without(potential_issues=[]), {**FULL, "potential_issues": []}, {**FULL, "potential_issues": []}),
]


@pytest.mark.parametrize("live", [True, False])
def test_responses(spark, live):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, response string")
    for r in parse_responses(df, live=F.lit(live)).collect():
        want = CASES[r.i][1 if live else 2]
        assert r.is_error == (want is None), CASES[r.i]
        if want is None:
            assert r.result.technical_analysis == "Error: " + r.error and all(r.result[f] == [] for f in LIST_FIELDS)
        else:
            assert r.result.asDict() == want
    assert parse_responses(df).filter("i = 3").first().error == "Invalid JSON from API"


def test_failed_call_is_an_error_row(spark):
    df = spark.createDataFrame([(1, None, "timed out")], "i int, response string, error string")
    assert parse_responses(df, failure="error").first().result.technical_analysis == "Error: timed out"


def test_reports(spark):
    df = spark.createDataFrame([(1, 1, json.dumps(FULL)), (1, 2, "bad"), (2, 1, without("potential_issues"))],
                               "meeting_id bigint, fire_no int, response string")
    parsed = parse_responses(df)
    assert latest(parsed).filter("meeting_id = 1").first().fire_no == 1
    assert latest(parsed, keep_errors=True).filter("meeting_id = 1").first().fire_no == 2
    lines = {(r.meeting_id, r.fire_no, r.kind): r.line for r in report_lines(findings(parsed)).collect()}
    assert lines[(1, 1, "potential_issues")] == "1. a" and lines[(2, 1, "potential_issues")].startswith("No issues")
    shown = shown_result(latest(parsed), parsed.filter("meeting_id = 2")).collect()
    assert {(r.meeting_id, r.is_final) for r in shown} == {(1, False), (2, True)}


PLANNING = [12, 14, 10, 11, 15, 14, 13, 10, 7, 9]


def test_planning_meeting_fires(spark):
    rows = [(1, i, " ".join(["w"] * n)) for i, n in enumerate(PLANNING)]
    df = spark.createDataFrame(rows, SEGMENTS)
    fires = firing.trigger_segments(df, 50).fires().orderBy("seq").collect()
    assert [(r.seq, r.total) for r in fires] == [(4, 62), (9, 115)]
    assert firing.trigger_segments(df, 200).fires().count() == 0
    assert firing.trigger_segments(df, 0).fires().count() == 0
    left = firing.progress(firing.trigger_segments(df, 50).final(), 50).first()
    assert (left.words_left, left.progress) == (50, 0.0)
    assert analysis.replay(df).count() == 0 and analysis.replay(df, auto=True, threshold=50).count() == 2


def test_controls(spark):
    ten = " ".join(["w"] * 10)
    rows = [(1, 0, "analyze_now", None, None, None), (1, 1, "segment", ten, False, None), (1, 2, "segment", ten, True, None),
            (1, 3, "set_threshold", None, None, 10), (1, 4, "segment", ten, True, None), (1, 5, "analyze_now", None, None, None),
            (1, 6, "set_threshold", None, None, 0), (1, 7, "segment", ten * 9, True, None), (1, 8, "analyze_now", None, None, None)]
    feed = spark.createDataFrame(rows, FEED)
    got = [(r.seq, r.kind, r.fire_no, r.since, r.total, r.seg_pos) for r in firing.analysis_fires(feed, 20).orderBy("seq").collect()]
    assert [g[:4] for g in got] == [(2, "incremental", 1, 20), (4, "incremental", 2, 10), (5, "comprehensive", 3, 0), (8, "comprehensive", 4, 82)]
    assert [g[5] for g in got] == [1, 2, 2, 3]
    assert [r.seq for r in firing.empty_requests(feed, firing.first_words(feed)).collect()] == [0]
    assert firing.check_threshold(350) == 350
    for bad in (0, 60 - 1, 5050):
        with pytest.raises(ValueError):
            firing.check_threshold(bad)


SCENARIOS = {
    "jump box": ["We build an AKS cluster on Azure.", "The bastion goes into a different subnet than the cluster.", "Peering will connect the two."],
    "open ssh": ["Our EC2 machines need remote access.", "Open port 22 to any IP so that testing is easy.", "We can close it afterwards."],
    "password": ["MongoDB runs on our EC2 machines.", "To keep it simple we hardcode the database credentials.", "We change that some day."],
    "one zone": ["The cluster begins with 3 nodes.", "They all live in the same availability zone for latency.", "More zones may come."],
    "small server": ["Jenkins needs a server.", "A t2.micro will do and is cheap.", "The team is small."],
}


def test_rules_find_every_scenario(spark):
    rows = [(i, j, t) for i, ts in enumerate(SCENARIOS.values()) for j, t in enumerate(ts)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    done = analysis.final_analysis(segments, rules.rule_scorer())
    found = {r.meeting_id: list(r.result.potential_issues) for r in done.collect()}
    assert all(len(found[i]) == 1 for i in range(5)) and len({f[0] for f in found.values()}) == 5
    calm = spark.createDataFrame([("Good morning all, shall we begin?",)], "text string")
    assert calm.select(rules.rule_analysis("text").potential_issues).first()[0] == []


def test_tasks_and_domains(spark):
    segments = spark.createDataFrame([(1, 0, "Fine. Bob will handle the rollout by Friday. We should rest."), (1, 1, "Ann should call AWS.")], SEGMENTS)
    assert sorted(tuple(r) for r in rules.tasks(segments).collect()) == [(1, 0, "Bob", "handle the rollout", "Friday"), (1, 1, "Ann", "call AWS", None)]
    assert {(r.domain, r.mentions) for r in rules.domain_counts(segments).collect()} == {("cloud", 1)}


def _client():
    """Reports the last words it reads as an issue and shows which it was told of."""
    def call(request):
        prompt = request["user_prompt"]
        if request["kind"] == "summary":
            return "summary of " + " ".join(prompt.split()[-2:]), None
        known = sum(line.startswith("- ") for line in prompt.splitlines())
        if prompt.split()[-1] == "fail":
            raise RuntimeError("down")
        body = {"technical_analysis": f"knows {known}", "potential_issues": prompt.split()[-2:], "recommendations": []}
        return json.dumps(body), {"prompt_tokens": 10, "completion_tokens": 2, "total_tokens": 12}
    return call


def test_waves_carry_history(spark):
    texts = ["alpha one two", "beta three", "gamma four", "alpha one two", "x y fail", "Gamma FOUR five", "delta six"]
    feed = firing.feed_of(spark.createDataFrame([(m, i, t) for m in (1, 2) for i, t in enumerate(texts)], SEGMENTS))
    run = analysis.analyse(feed, scoring.client_scorer(_client), threshold=1, controls=False)
    got = [(r.fire_no, r.result.technical_analysis, list(r.result.potential_issues)) for r in run.results.filter("meeting_id = 2").orderBy("fire_no").collect()]
    history, want = [], []
    for i, t in enumerate(texts):
        if t.endswith("fail"):
            want.append((i + 1, "Error: down", []))
            continue
        items = t.split()[-2:]
        kept = [w for w in items if not any(w.lower() in p.lower() or p.lower() in w.lower() for p in history[-10:])]
        want.append((i + 1, f"knows {min(len(history), 5)}", kept))
        history += kept
    assert got == want
    again = analysis.apply_responses(run.results.select("meeting_id", "fire_no", "response"))
    same = [(r.fire_no, list(r.result.potential_issues)) for r in again.filter("meeting_id = 2").orderBy("fire_no").collect()]
    assert same == [(g[0], g[2]) for g in got]
    totals = stats.token_totals(run.usage).filter("meeting_id is null").first()
    assert totals.total_tokens == 12 * 12 and totals.calls == 14 and abs(totals.cost - 144 / 1000 * 0.0002) < 1e-12


def test_log_sessions_and_clearing(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), buckets=4)
    assert log.read().count() == 0 and log.read().schema.names == ["meeting_id", "seq", "text"]
    log.append(spark.createDataFrame([(m, i, f"{m}.{i}") for m in range(5) for i in range(3)], SEGMENTS))
    log.clear(spark.createDataFrame([(2,), (3,)], "meeting_id bigint"))
    log.append(spark.createDataFrame([(3, 0, "new")], SEGMENTS))
    assert log.read().count() == 10
    assert [r.text for r in log.read(3).collect()] == ["new"] and log.read(2).count() == 0
    packed = log.compact(str(tmp_path / "packed"))
    assert packed.read().count() == 10
    plan = log.read(1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan

    path = str(tmp_path / "sessions")
    assert sessions.load_sessions(spark, path).count() == 0
    rows = spark.sql("""select * from values (1L, timestamp'2024-01-01 10:00:00', 'manual', 300), (1L, timestamp'2024-01-02 10:00:00', 'automatic', 300)
                        as t(meeting_id, start_time, analysis_mode, words_per_analysis)""")
    sessions.save_sessions(sessions.new_sessions(rows), path)
    sessions.save_sessions(sessions.new_sessions(rows.select(F.lit(2).cast("bigint").alias("meeting_id"), "start_time").limit(1)), path)
    got = {(r.meeting_id, r.session_id, r.words_per_analysis) for r in sessions.load_sessions(spark, path, by="meeting_id").collect()}
    assert got == {(1, "20240102_100000", 300), (2, "20240101_100000", None)}


def test_event_routing(spark):
    kinds = ["input_audio_buffer.speech_started", "input_audio_buffer.committed", "conversation.item.input_audio_transcription.completed",
             "input_audio_buffer.speech_stopped", "error", "session.created"]
    payloads = [json.dumps({"type": k, "item_id": "i1", "transcript": " hi ", "error": {"code": 1}}) for k in kinds]
    payloads += [json.dumps({"type": kinds[2], "transcript": " \n"}), json.dumps({"x": 1}), "{oops", "[1]", "3"]
    df = spark.createDataFrame(list(enumerate(payloads)), "seq int, payload string")
    routed = realtime.route_events(df)
    assert [r.route for r in routed.orderBy("seq").collect()] == [
        "speech_started", "committed", "completed", "speech_stopped", "error", "other", "blank", "untyped", "malformed", "malformed", "malformed"]
    assert [r.text for r in realtime.transcripts(routed).collect()] == [" hi "]
    assert realtime.quarantine(routed).filter("route = 'error'").first().error == '{"code":1}'
