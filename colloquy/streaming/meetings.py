"""Live meetings from end to end: fires, contexts, model calls, findings, final analyses, in one stateful operator.

What an analysis reads depends on the answers before it: the summaries written
so far and the issues that were kept. So a meeting's requests are answered one
after the other where its state lies, and each answer goes into that state
before the next request is written. With a ledger (``ledger.asked_once``) a
task that runs again does not ask again. A meeting's state is bounded: counters,
the last segments up to 1,000 words, summaries of 1,000 words, ten findings a
kind.
"""


from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.fixed_values import (
    COMPREHENSIVE_TAIL_WORDS, FINAL_TAIL_WORDS, HISTORY_FIELDS, HISTORY_ITEMS, LIST_FIELDS, MAX_TOKENS, NO_TRANSCRIPT,
    PROMPT_ISSUES, RECENT_SEGMENTS, RETRY_SEGMENTS, SUMMARY_WORD_BUDGET, TEMPERATURE, WORDS_PER_ANALYSIS, WORDS_PER_ROLLING_SUMMARY,
)
from colloquy.functions.responses import parse_responses
from colloquy.plans.contexts import ISSUES_HEAD, PHASES_HEAD, RECENT_HEAD
from colloquy.plans.prompts import SYSTEM_PROMPTS
from colloquy.plans.scoring import _history, answer
from colloquy.streaming.triggers import WordTrigger, run_meetings

CALLS = T.StructType([
    T.StructField("meeting_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("epoch", T.LongType()),
    T.StructField("kind", T.StringType()),  # incremental, comprehensive, final, summary, empty or late
    T.StructField("fire_no", T.LongType()), T.StructField("total", T.LongType()), T.StructField("minutes", T.LongType()),
    T.StructField("retried", T.BooleanType()), T.StructField("request_id", T.StringType()), T.StructField("user_prompt", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()), T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("total_tokens", T.IntegerType()), T.StructField("text", T.StringType()),  # of late rows
    *[T.StructField(f"_{f}", T.ArrayType(T.StringType())) for f in HISTORY_FIELDS],
])
_FINDINGS = T.StructType([T.StructField("seen", T.ArrayType(T.StringType())), T.StructField("shown", T.ArrayType(T.StringType()))])


def _sections(*parts: str | None) -> str:
    return "\n\n".join(p for p in parts if p is not None)


class LiveMeeting(WordTrigger):
    """A meeting whose requests are answered by the client that ``make_client()`` returns, made once per task."""

    schema, keep = CALLS, dict(segments=RETRY_SEGMENTS, words=FINAL_TAIL_WORDS)

    def __init__(self, make_client, threshold=WORDS_PER_ANALYSIS, summary_words=WORDS_PER_ROLLING_SUMMARY, idle_ms=None, **more):
        super().__init__(threshold, summary_words, idle_ms, **more)
        self.make_client = make_client

    def init(self, handle) -> None:
        super().init(handle)
        self.client = None
        self.summaries = handle.getListState("summaries", "text string")
        self.findings = handle.getMapState("findings", "kind string", _FINDINGS)

    def forget(self) -> None:
        self.summaries.clear()
        self.findings.clear()

    # Contexts: the same texts as in plans.contexts, from the state of one meeting.

    def phases(self) -> str | None:
        kept = [s[0] for s in self.summaries.get()] if self.summaries.exists() else []
        return PHASES_HEAD + "\n" + "\n".join(f"\nPhase {i}:\n{t}" for i, t in enumerate(kept, 1)) if kept else None

    def issues(self) -> str | None:
        shown = self.known(HISTORY_FIELDS[0])[1]
        return "\n".join([ISSUES_HEAD, *(f"- {t}" for t in shown[-PROMPT_ISSUES:])]) if shown else None

    def known(self, kind: str) -> tuple[list, list]:
        if not self.findings.containsKey((kind,)):
            return [], []
        seen, shown = self.findings.getValue((kind,))
        return list(seen), list(shown)

    @staticmethod
    def tail(walk, n: int) -> str:
        text = " ".join(walk.heard)
        return text if walk.total <= n else " ".join(text.split()[-n:])

    def prompt(self, walk, fire) -> str:
        on_demand = fire["kind"] == "comprehensive"
        facts = f"Minutes: {walk.minutes}\nWords: {walk.total}\nAnalyses so far: {fire['fire_no'] - 1}\nMode: {'on demand' if on_demand else 'automatic'}"
        if on_demand:
            n = COMPREHENSIVE_TAIL_WORDS
            head = f"Discussion, last {n} of {walk.total} words:" if walk.total > n else f"Whole discussion, {walk.total} words:"
            heard = f"{head}\n{self.tail(walk, n)}"
        else:
            heard = RECENT_HEAD + "\n" + " ".join(walk.heard[-RECENT_SEGMENTS:])
        return _sections(facts, self.issues(), self.phases(), heard)

    @staticmethod
    def final_prompt(minutes, total, analyses, phases, tail) -> str:
        head = f"Transcript, last {FINAL_TAIL_WORDS} words:" if total > FINAL_TAIL_WORDS else "Whole transcript:"
        return _sections(f"Meeting over\nMinutes: {minutes}\nWords: {total}\nAnalyses: {analyses}", phases, f"{head}\n{tail}")

    # Calls.

    def ask(self, meeting, kind, fire_no, prompt) -> dict:
        if self.client is None:
            self.client = self.make_client()
        request = {"request_id": f"{meeting}-{kind}-{fire_no}", "meeting_id": meeting, "fire_no": fire_no, "kind": kind,
                   "system_prompt": SYSTEM_PROMPTS[kind], "user_prompt": prompt, "temperature": TEMPERATURE,
                   "max_tokens": MAX_TOKENS[kind], "json_mode": kind != "summary"}
        return {**answer(self.client, request), "user_prompt": prompt}

    def outcome(self, meeting, walk, fire) -> list[dict]:
        fire = {"meeting_id": meeting, "total": None, **{k: v for k, v in fire.items() if k not in ("since", "recent")}}
        summary, kind = fire.pop("summary_text", None), fire["kind"]
        if kind == "late":
            return [fire]
        if kind == "empty":
            return [{**fire, "error": NO_TRANSCRIPT}]
        if kind == "final":
            return self.final(meeting, walk, fire)
        rows = []
        if fire["summary_fired"]:
            rows.append({**fire, **self.ask(meeting, "summary", fire["fire_no"], summary)})
            if rows[0]["error"] is None and rows[0]["response"] is not None:
                self.write_summary(rows[0]["response"])
        row = self.ask(meeting, kind, fire["fire_no"], self.prompt(walk, fire))
        row.update(self.sift(_history(row, HISTORY_FIELDS, LIST_FIELDS)))
        return [*rows, {**fire, **row}]

    def write_summary(self, text: str) -> None:
        """Add a summary and let go of the oldest while there are too many words."""
        kept = [*([s[0] for s in self.summaries.get()] if self.summaries.exists() else []), text]
        while kept and sum(len(t.split()) for t in kept) > SUMMARY_WORD_BUDGET:
            kept.pop(0)
        if kept:
            self.summaries.put([(t,) for t in kept])
        else:
            self.summaries.clear()

    def sift(self, texts: dict | None) -> dict:
        """What an answer adds to the findings; a failed one adds nothing."""
        found = {}
        for kind in HISTORY_FIELDS if texts is not None else ():
            seen, shown = self.known(kind)
            fresh = [t for t in texts[kind] if not any(t.lower() in s or s in t.lower() for s in seen)]
            if fresh:
                self.findings.updateValue((kind,), ((seen + [t.lower() for t in fresh])[-HISTORY_ITEMS:], (shown + fresh)[-HISTORY_ITEMS:]))
            found[f"_{kind}"] = fresh
        return found

    def final(self, meeting, walk, fire) -> list[dict]:
        """The final analysis, and if its call fails one more on the last segments."""
        if not walk.heard:
            return [{**fire, "error": NO_TRANSCRIPT}]
        prompt = self.final_prompt(walk.minutes, walk.total, walk.fires, self.phases(), self.tail(walk, FINAL_TAIL_WORDS))
        row = self.ask(meeting, "final", 0, prompt)
        if row["error"] is None and self.usable(row["response"]):
            return [{**fire, **row, "retried": False}]
        texts, sizes = walk.heard[-RETRY_SEGMENTS:], walk.sizes[-RETRY_SEGMENTS:]
        tail = " ".join(texts) if sum(sizes) <= FINAL_TAIL_WORDS else " ".join(" ".join(texts).split()[-FINAL_TAIL_WORDS:])
        return [{**fire, **self.ask(meeting, "final", 0, self.final_prompt(0, sum(sizes), 0, None, tail)), "retried": True}]

    @staticmethod
    def usable(response: str | None) -> bool:
        """Whether a final answer is one, by the rules of parse_responses: an object whose lists are lists."""
        import json

        def strict(pairs):
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError("repeated key")
            return dict(pairs)

        try:
            found = json.loads(response, object_pairs_hook=strict)
        except (TypeError, ValueError):
            return False
        return isinstance(found, dict) and all(found.get(f) is None or isinstance(found[f], list) for f in LIST_FIELDS)


def live_calls(feed: DataFrame, make_client, threshold=WORDS_PER_ANALYSIS, summary_words=WORDS_PER_ROLLING_SUMMARY, idle_ms=None) -> DataFrame:
    """Every request of a streaming feed with its answer, as soon as it is due: columns of CALLS.

    ``minutes`` of the feed (see ``sessions.with_minutes``) go into prompts, 0
    without them. Summaries come out before the analysis they belong to, a
    ``stop`` or ``idle_ms`` of silence gives the final analysis, requests before
    the first word give an ``empty`` row with an error.
    """
    return run_meetings(feed, LiveMeeting(make_client, threshold, summary_words, idle_ms))


def live_results(calls: DataFrame) -> DataFrame:
    """Analyses among ``calls`` (a table or a stream) parsed into ``result``, ``is_error``, ``error``, with repeated findings left out."""
    asked = calls.filter(F.col("kind").isin("incremental", "comprehensive", "final", "empty"))
    parsed = parse_responses(asked, live=F.col("kind") != "final", failure="error")
    result = F.col("result")
    for f in HISTORY_FIELDS:
        result = result.withField(f, F.coalesce(f"_{f}", F.col(f"result.{f}")))
    return parsed.withColumn("result", result).drop(*[f"_{f}" for f in HISTORY_FIELDS], "text")
