"""Scoring requests with an injected model client."""

import json

import pandas as pd
from pyspark.sql import DataFrame, types as T

_OUT = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("meeting_id", T.LongType()),
    T.StructField("fire_no", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()), T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("total_tokens", T.IntegerType()),
])
_KEYS = ["request_id", "meeting_id", "fire_no", "kind"]
_USAGE = ["prompt_tokens", "completion_tokens", "total_tokens"]


def answer(client, request: dict) -> dict:
    """One call as a row of the output; a call that raises becomes a row with ``error``."""
    row = {k: request[k] for k in _KEYS}
    try:
        if request["system_prompt"] is None:
            raise ValueError(f"unknown kind of request: {request['kind']}")
        response, usage = client(request)
        row.update(response=response, error=None, **{u: (usage or {}).get(u) for u in _USAGE})
    except Exception as problem:
        row.update(response=None, error=str(problem) or type(problem).__name__, **dict.fromkeys(_USAGE))
    return row


def client_scorer(make_client, reads_history=True):
    """A scorer (requests -> responses) around a model client.

    ``make_client()`` runs once per task and returns a callable that takes one
    request as a dict and returns ``(response, usage)``, usage being a dict
    with the three token counts or None. A call that raises becomes a row with
    ``error``; it never fails the task.
    """
    def call_all(batches):
        client = make_client()
        for pdf in batches:
            out = pd.DataFrame([answer(client, request) for request in pdf.to_dict("records")], columns=_OUT.names)
            out[_USAGE] = out[_USAGE].astype("Int32")
            yield out

    def score(requests: DataFrame) -> DataFrame:
        return requests.mapInPandas(call_all, _OUT)

    score.reads_history, score.make_client = reads_history, make_client
    return score


def _history(row: dict, fields, lists):
    """The texts of the history fields of a response; None if it is an error, by the rules of running analyses."""
    def strict(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    if row["error"] is not None:
        return None
    try:
        found = json.loads(row["response"], object_pairs_hook=strict)
    except (TypeError, ValueError):
        return None
    if not isinstance(found, dict) or any(found.get(f) is not None and not isinstance(found[f], list) for f in lists):
        return None
    texts = {f: found.get(f, []) for f in fields}
    if any(t is None or any(not isinstance(i, str) for i in t) for t in texts.values()):
        return None
    return texts


def score_in_order(requests: DataFrame, make_client, fields, lists, marker: str, head: str, issues_kept: int, window: int) -> DataFrame:
    """Score each meeting's requests one after the other, each with what survived before it, in one pass.

    A meeting's answers depend on each other, so its requests go to one task in
    order and are streamed: the state is the last survivors of the present
    meeting. ``marker`` stands for the known issues in the prompts, under
    ``head``; a prompt without known issues loses that section. Adds the
    survivors of each of ``fields``, null for failed analyses.
    """
    schema = T.StructType([*_OUT.fields, *[T.StructField(f"_{f}", T.ArrayType(T.StringType())) for f in fields]])

    def run(batches):
        client = make_client()
        meeting, seen, issues = None, {}, []
        for pdf in batches:
            rows = []
            for request in pdf.to_dict("records"):
                if request["meeting_id"] != meeting:
                    meeting, seen, issues = request["meeting_id"], {f: [] for f in fields}, []
                known = f"\n\n{head}\n" + "\n".join(f"- {i}" for i in issues[-issues_kept:]) if issues else ""
                request["user_prompt"] = request["user_prompt"].replace(f"\n\n{head}\n{marker}", known)
                row = answer(client, request)
                texts = _history(row, fields, lists)
                for f in fields:
                    row[f"_{f}"] = None
                    if texts is not None:
                        fresh = [t for t in texts[f] if not any(t.lower() in s or s in t.lower() for s in seen[f])]
                        seen[f] = (seen[f] + [t.lower() for t in fresh])[-window:]
                        row[f"_{f}"] = fresh
                        if f == "potential_issues":
                            issues = (issues + fresh)[-window:]
                rows.append(row)
            out = pd.DataFrame(rows, columns=schema.names)
            out[_USAGE] = out[_USAGE].astype("Int32")
            yield out

    return requests.repartition("meeting_id").sortWithinPartitions("meeting_id", "fire_no").mapInPandas(run, schema)
