"""The number of stored tables does not grow with the data, and a model is asked once."""

import json

import pytest

from colloquy.operators import firing, novelty
from colloquy.plans import analysis, scoring


@pytest.mark.parametrize("blocks", [4, 12, 40])
def test_repeats_in_a_fixed_number_of_tables(spark, monkeypatch, blocks):
    """Survivors at the begin, then only repeats and empty lists."""
    rows = [(1, i, [f"issue {i % 3}"] if i < 3 or i % 4 else []) for i in range(blocks * 8)] + [(2, i, [f"x{i}"]) for i in range(9)]
    df = spark.createDataFrame(rows, "meeting_id bigint, fire_no bigint, items array<string>")
    written = []
    store = novelty.cut_lineage
    monkeypatch.setattr(novelty, "cut_lineage", lambda d: written.append(1) or store(d))
    got = {(r.meeting_id, r.fire_no): list(r["items"]) for r in novelty.suppress_repeats(df, ["meeting_id"], "fire_no", "items", bits=3).collect()}
    assert len(written) <= 3 + 2 * novelty.ROUNDS
    seen = {}
    for meeting, i, items in rows:
        kept = [t for t in items if not any(t in s or s in t for s in seen.get(meeting, []))]
        seen[meeting] = (seen.get(meeting, []) + kept)[-10:]
        assert got[meeting, i] == kept


def test_histories_in_a_fixed_number_of_tables(spark, monkeypatch):
    written = []
    store = analysis.cut_lineage
    monkeypatch.setattr(analysis, "cut_lineage", lambda d: written.append(1) or store(d))

    def client():
        return lambda request: (json.dumps({"technical_analysis": "t", "potential_issues": [request["user_prompt"][-40:]]}), None)

    counts = []
    for n in (4, 30):
        written.clear()
        feed = firing.feed_of(spark.createDataFrame([(1, i, f"{i} " * 60) for i in range(n)], "meeting_id bigint, seq bigint, text string"))
        run = analysis.analyse(feed, scoring.client_scorer(client), 50, controls=False)
        assert run.results.count() == n
        counts.append(len(written))
    assert counts[0] == counts[1]


def test_a_retry_asks_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client():
        def call(request):
            with open(log, "a") as file:
                file.write("call\n")
            if len(request["user_prompt"].split()) > 60:
                raise TimeoutError("timed out")
            return json.dumps({"technical_analysis": "short"}), None
        return call

    rows = spark.createDataFrame([(m, i, "some words here") for m in (1, 2) for i in range(30)], "meeting_id bigint, seq bigint, text string")
    done = analysis.final_analysis(rows, scoring.client_scorer(client))
    for _ in range(3):
        assert done.filter("retried and not is_error").count() == 2
    assert len(open(log).readlines()) == 4
