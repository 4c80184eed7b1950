"""Word triggers on a live feed, one small state per meeting."""

from collections import namedtuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.fixed_values import (
    RECENT_SEGMENTS, SUMMARY_SEGMENTS, WORDS_PER_ANALYSIS, WORDS_PER_ROLLING_SUMMARY,
)
from colloquy.functions.text import n_words

FIRES = T.StructType([
    T.StructField("meeting_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),  # incremental, comprehensive, empty, final or late
    T.StructField("fire_no", T.LongType()), T.StructField("since", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("summary_fired", T.BooleanType()),
    T.StructField("recent", T.StringType()), T.StructField("summary_text", T.StringType()),
    T.StructField("text", T.StringType()),  # of late rows
    T.StructField("minutes", T.LongType()), T.StructField("epoch", T.LongType()),
])
_STATE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("total", T.LongType()), T.StructField("fired_at", T.LongType()),
    T.StructField("summary_at", T.LongType()), T.StructField("fires", T.LongType()),
    T.StructField("threshold", T.LongType()), T.StructField("minutes", T.LongType()), T.StructField("epoch", T.LongType()),
    T.StructField("void", T.LongType()), T.StructField("heard", T.ArrayType(T.StringType())),
    T.StructField("sizes", T.ArrayType(T.LongType())),
])
_ENDED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("void", T.LongType())])
ROW = namedtuple("ROW", "seq event text auto value n_words epoch minutes")  # of ``feed_rows``
LAST = 1 << 62                  # the place of a mark: behind all rows of its epoch
MARKER_MS = 7 * 86_400_000      # how long an ended meeting is remembered


class Walk:
    """What a meeting has come to, and what each further row makes of it.

    ``heard`` are the last segments with their ``sizes`` in words: at least
    ``segments`` of them, and as many as hold ``words`` words.
    """

    def __init__(self, saved, threshold, summary_words, segments=SUMMARY_SEGMENTS, words=0):
        self.first, self.summary_words, self.segments, self.words = threshold, summary_words, segments, words
        self.ended = False
        if saved is None:
            self.begin(-1)
        else:
            (self.seq, self.total, self.fired_at, self.summary_at, self.fires, self.threshold, self.minutes, self.epoch, self.void,
             heard, sizes) = saved
            self.heard, self.sizes = list(heard), [int(n) for n in sizes]

    def begin(self, void):
        self.seq, self.total, self.fired_at, self.summary_at, self.fires, self.threshold = -1, 0, 0, 0, 0, self.first
        self.minutes, self.epoch, self.void, self.heard, self.sizes, self.ended = 0, 0, void, [], [], False

    def saved(self):
        return (self.seq, self.total, self.fired_at, self.summary_at, self.fires, self.threshold, self.minutes, self.epoch, self.void,
                self.heard, self.sizes)

    def row(self, kind, **more):
        return {"seq": self.seq, "kind": kind, "minutes": self.minutes, "epoch": self.epoch, **more}

    def end(self, kind="final"):
        """The request for the final analysis; rows that follow are late."""
        self.ended = True
        return self.row(kind, fire_no=self.fires, since=self.total - self.fired_at, total=self.total)

    def hear(self, text, size):
        self.total += size
        self.heard.append(text)
        self.sizes.append(size)
        held = sum(self.sizes)
        while len(self.heard) > self.segments and held - self.sizes[0] >= self.words:
            held -= self.sizes.pop(0)
            self.heard.pop(0)

    def step(self, row):
        """The fire that a row of the feed sets off, or None."""
        if row.epoch <= self.void:
            return None                 # written before its meeting was cleared
        if row.event == "clear":
            self.ended = row.seq != LAST
            if not self.ended:
                self.begin(int(row.epoch))
            return None
        if self.ended and row.seq == 0:
            self.begin(self.void)
        if self.ended or row.seq <= self.seq:
            return {"seq": row.seq, "kind": "late", "text": row.text, "epoch": row.epoch}
        self.seq, self.epoch, kind = int(row.seq), int(row.epoch), None
        self.minutes = max(self.minutes, int(row.minutes))
        if row.event == "stop":
            return self.end()
        if row.event == "segment":
            self.hear(row.text, int(row.n_words))
            if row.auto and self.threshold > 0 and self.total - self.fired_at >= self.threshold:
                kind = "incremental"
        elif row.event == "set_threshold":
            self.threshold = int(row.value)
        elif row.event == "analyze_now":
            kind = "comprehensive" if self.total else "empty"
        if kind is None or kind == "empty":
            return kind and self.row(kind, total=self.total)
        summary = self.total - self.summary_at >= self.summary_words
        self.fires += 1
        fire = self.row(kind, fire_no=self.fires, since=self.total - self.fired_at, total=self.total, summary_fired=summary,
                        recent=" ".join(self.heard[-RECENT_SEGMENTS:]),
                        summary_text=" ".join(self.heard[-SUMMARY_SEGMENTS:]) if summary else None)
        self.fired_at = self.total
        self.summary_at = self.total if summary else self.summary_at
        return fire


class WordTrigger(StatefulProcessor):
    """Counters, the current threshold and the last five segments of a meeting.

    Rows of a micro-batch are put in order first; a row at or before the last
    position applied comes out as ``late`` and changes nothing. A ``stop`` row
    comes out as ``final``, the request for the final analysis, and ends the
    meeting; so does a silence of ``idle_ms``, by a timer. A ``clear`` row ends
    it without a word. What is left of an ended meeting is a marker of two
    numbers for ``marker_ms``: until then its rows are late, unless they begin
    at position 0 again. A mark of a cleared log (``clear`` without a position)
    voids all rows of its epoch and earlier ones; they do not come out.
    """

    schema, keep = FIRES, dict(segments=SUMMARY_SEGMENTS, words=0)

    def __init__(self, threshold=WORDS_PER_ANALYSIS, summary_words=WORDS_PER_ROLLING_SUMMARY, idle_ms=None, marker_ms=MARKER_MS):
        self.threshold, self.summary_words, self.idle_ms, self.marker_ms = threshold, summary_words, idle_ms, marker_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("meeting", _STATE)
        self.marker = handle.getValueState("ended", _ENDED, self.marker_ms)

    def walk(self) -> Walk:
        """One or two calls to the store: a meeting has counters or a marker, never both."""
        saved = self.state.get()
        walk = Walk(saved, self.threshold, self.summary_words, **self.keep)
        marker = self.marker.get() if saved is None else None
        self.marked = marker is not None
        if self.marked:
            seq, void = marker
            # A meeting that was stopped goes on from position 0 only; a cleared log goes on with later epochs.
            walk.seq, walk.void, walk.ended = seq, void, seq >= 0
        return walk

    def handleInputRows(self, key, rows, timerValues):
        batch = [row for part in rows for row in map(ROW, *(part[name].tolist() for name in ROW._fields))]
        walk, out = self.walk(), []
        for row in sorted(batch, key=lambda row: (row.epoch, row.seq)):
            before = walk.ended
            fire = walk.step(row)
            if before and not walk.ended or row.event == "clear":
                self.forget()
            if fire is not None:
                out += self.outcome(key[0], walk, fire)
        self.save(walk, timerValues)
        if out:     # a frame for each meeting without a fire costs more than its walk
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        walk = self.walk()
        out = self.outcome(key[0], walk, walk.end())
        self.save(walk, timerValues)
        yield self.frame(out)

    def outcome(self, meeting, walk, fire) -> list[dict]:
        """The rows that a fire gives."""
        return [{"meeting_id": meeting, **fire}]

    def forget(self) -> None:
        """Give up what the meeting before has left besides its counters."""

    def save(self, walk, timerValues) -> None:
        for timer in list(self.handle.listTimers()) if self.idle_ms else ():
            self.handle.deleteTimer(timer)
        if walk.ended or walk.seq < 0:
            self.state.clear()
            self.forget()
            self.marker.update((walk.seq, walk.void))
            return
        if self.marked:
            self.marker.clear()
        self.state.update(walk.saved())
        if self.idle_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        kinds = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.BooleanType(): "boolean"}
        return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=kinds.get(f.dataType, object)) for f in self.schema.fields})

    def close(self) -> None:
        pass


def feed_rows(feed: DataFrame) -> DataFrame:
    """A feed as the live operators take it; words are counted JVM-side. ``epoch`` and ``minutes`` count as 0 where the feed has none."""
    given = lambda name: F.coalesce(name, F.lit(0)) if name in feed.columns else F.lit(0)
    return feed.select(
        "meeting_id", F.coalesce("seq", F.lit(LAST)).alias("seq"), "event",
        F.when(F.col("event") == "segment", F.coalesce("text", F.lit(""))).otherwise(F.col("text")).alias("text"), F.coalesce("auto", F.lit(True)).alias("auto"),
        F.coalesce("value", F.lit(0)).alias("value"),
        F.when(F.col("event") == "segment", F.coalesce(n_words("text"), F.lit(0))).otherwise(F.lit(0)).alias("n_words"),
        given("epoch").cast("bigint").alias("epoch"), given("minutes").cast("bigint").alias("minutes"))


def run_meetings(feed: DataFrame, processor: WordTrigger) -> DataFrame:
    """A processor of meetings over a streaming feed. Timers and markers need the processing time."""
    return feed_rows(feed).groupBy("meeting_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="ProcessingTime")


def live_fires(feed: DataFrame, threshold=WORDS_PER_ANALYSIS, summary_words=WORDS_PER_ROLLING_SUMMARY, idle_ms=None) -> DataFrame:
    """Fires (and late rows) of a streaming feed."""
    return run_meetings(feed, WordTrigger(threshold, summary_words, idle_ms))
