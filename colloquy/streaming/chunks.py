"""Overlapping chunks of a live measure, one small state per key."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.fixed_values import CHUNK_SAMPLES, FLUSH_SAMPLES, OVERLAP_SAMPLES

CHUNKS = [("chunk_no", "bigint"), ("start", "bigint"), ("end", "bigint"), ("flushed", "boolean")]
_STATE = "place bigint, total bigint, buffered bigint, chunks bigint, flushed boolean"


class LiveChunker(StatefulProcessor):
    """Where a key's measure stands: its total, what is buffered of it (the overlap included) and the chunks so far.

    Rows of a micro-batch are put in order first; rows at or before the last
    place applied, and rows behind a ``stop``, change nothing.
    """

    def __init__(self, keys, chunk, overlap, flush, flush_only_new):
        self.keys, self.chunk, self.overlap, self.flush, self.flush_only_new = keys, chunk, overlap, flush, flush_only_new

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("measure", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("place", kind="stable")
        place, total, buffered, chunks, flushed = self.state.get() if self.state.exists() else (-1, 0, 0, 0, False)
        out = []
        for row in batch.itertuples(index=False, name=None):
            at, size, stop = row[-3:]
            if flushed or at <= place:
                continue
            place = int(at)
            if stop:
                flushed = True
                rest = self.flush is not None and buffered > self.flush
                if rest and (chunks == 0 or not self.flush_only_new or buffered > self.overlap):
                    chunks += 1
                    out.append((*key, chunks, total - buffered, total, True))
                continue
            total += int(size)
            buffered += int(size)
            if buffered >= self.chunk:
                chunks += 1
                out.append((*key, chunks, total - buffered, total, False))
                buffered = self.overlap
        self.state.update((place, total, buffered, chunks, flushed))
        found = pd.DataFrame(out, columns=[*self.keys, *(name for name, _ in CHUNKS)])
        yield found.astype({name: "boolean" if kind == "boolean" else "Int64" for name, kind in CHUNKS})

    def close(self) -> None:
        pass


def live_chunks(stream: DataFrame, keys, order: str, size: str, stop="stop", chunk=CHUNK_SAMPLES, overlap=OVERLAP_SAMPLES,
                flush=FLUSH_SAMPLES, flush_only_new=False) -> DataFrame:
    """Chunks of a stream as by :func:`operators.chunker.overlapping_chunks`, each as soon as it is full.

    A row whose ``stop`` is true ends its key and flushes the rest; its size
    does not count. State: five numbers a key.
    """
    if not 0 <= overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    keys = list(keys)
    rows = stream.select(*keys, F.col(order).cast("bigint").alias("place"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("amount"),
                         F.coalesce(F.col(stop), F.lit(False)).alias("ended"))
    types = {f.name: f.dataType for f in stream.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in CHUNKS)).fields)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=LiveChunker(keys, chunk, overlap, flush, flush_only_new), outputStructType=schema, outputMode="Append", timeMode="None")
