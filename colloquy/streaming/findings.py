"""Suppression of repeated findings on a live stream of analyses."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.fixed_values import HISTORY_FIELDS, HISTORY_ITEMS

KEPT = T.StructType([
    T.StructField("meeting_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("fire_no", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("late", T.BooleanType()),  # at or before an analysis already applied: not sifted, changes nothing
])
_STATE = T.StructType([
    T.StructField("fire_no", T.LongType()), T.StructField("seen", T.ArrayType(T.StringType()))])


class RecentFindings(StatefulProcessor):
    """Remembers the last survivors per meeting and kind, lower-cased."""

    def __init__(self, window=HISTORY_ITEMS):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("findings", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("fire_no", kind="stable")
        done, seen = self.state.get() if self.state.exists() else (-1, [])
        seen, out = list(seen), []
        for row in batch.itertuples(index=False):
            if row.fire_no <= done:
                out.append((key[0], key[1], row.fire_no, list(row.texts), True))
                continue
            done = int(row.fire_no)
            fresh = [(t, low) for t, low in zip(row.texts, row.lows)
                     if not any(low in s or s in low for s in seen)]
            seen = (seen + [low for _, low in fresh])[-self.window:]
            out.append((key[0], key[1], done, [t for t, _ in fresh], False))
        self.state.update((done, seen))
        yield pd.DataFrame(out, columns=KEPT.names)

    def close(self) -> None:
        pass


def live_survivors(results: DataFrame, window=HISTORY_ITEMS) -> DataFrame:
    """Kept issues and recommendations of a stream of parsed responses."""
    lists = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f"result.{f}").alias("items")) for f in HISTORY_FIELDS])
    items = results.filter(~F.col("is_error")).select("meeting_id", "fire_no", F.inline(lists))
    rows = items.select("meeting_id", "kind", F.col("fire_no").cast("bigint"), F.col("items").alias("texts"),
                        F.transform("items", F.lower).alias("lows"))
    return rows.groupBy("meeting_id", "kind").transformWithStateInPandas(
        statefulProcessor=RecentFindings(window), outputStructType=KEPT, outputMode="Append", timeMode="None")
