"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words; of scripts written without blanks,
each character is one. Stretches of ``seed`` words that a document shares with
a benchmark item bring the pair together. Then the longest common stretch not
yet covered is marked in both, again and again, until none of ``seed`` words is
left; how much of the item is covered at the end decides. Since marks may lie
in any order, an item whose passages were moved around is found as well. In
each round, Karp-Rabin hashes of all uncovered stretches of the least length
find the places that agree; they are compared, and those that follow one
another make the longer stretches. Items of fewer than ``seed`` words must be
there as a whole.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import arrow_schema, keep_rows, ship, slices

SEED = 5                    # words of the shortest tile
COVERAGE = 0.5              # share of an item's words from which a document is contaminated by it
BLOCK_ITEMS = 4_096         # items that are sent to all tasks at once
BLOCK_WORDS = 1_000_000     # and their words; longer benchmarks are handled block after block
#: Thai, Lao, Burmese, Khmer, Japanese and Chinese characters, first and last of each range.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"(?![{UNSPACED}])\\w(?:(?![{UNSPACED}])\\w)*|(?=\\w)[{UNSPACED}]")
_B = 0x9E3779B97F4A7C15


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def numbers(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Words as numbers: those of the benchmark by ``known``, all others 0."""
    get = known.get
    return np.array([get(w, 0) for w in words], np.int64)


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all stretches of ``length`` numbers."""
    h = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for i in range(length):
        h = h * np.uint64(_B) + ids[i:len(ids) - length + 1 + i].astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length): longest first, non-overlapping; of equal ones the leftmost in item, then doc.

    Numbers of 0 match nothing.
    """
    free_doc, free_item, tiles = doc != 0, item != 0, []
    if len(item) < least or len(doc) < least:
        return tiles
    hash_doc, hash_item = rolling(doc, least), rolling(item, least)

    def stretches():
        """Uncovered common stretches as long as they go: (length, place in item, place in doc), negative lengths."""
        clear = lambda free: np.flatnonzero(np.convolve(free, np.ones(least, np.int64), "valid") == least)
        i, j = clear(free_doc), clear(free_item)
        i = i[np.isin(hash_doc[i], hash_item[j])]
        j = j[np.argsort(hash_item[j], kind="stable")]
        low, high = (np.searchsorted(hash_item[j], hash_doc[i], side) for side in ("left", "right"))
        many = high - low
        ends = np.cumsum(many)
        j = j[np.repeat(low - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        i = np.repeat(i, many)
        for k in range(least):      # equal hashes are compared
            same = doc[i + k] == item[j + k]
            i, j = i[same], j[same]
        # Places that follow one another on a diagonal are one stretch.
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(begins, len(i))) + least - 1
        order = np.lexsort((i[begins], j[begins], -lengths))
        return zip((-lengths[order]).tolist(), j[begins][order].tolist(), i[begins][order].tolist())

    while True:
        longest, marked = None, len(tiles)
        for n, j, i in stretches():
            longest = n if longest is None else longest
            if n > longest:
                break       # shorter stretches may have lost parts: look again
            if free_doc[i:i - n].all() and free_item[j:j - n].all():
                free_doc[i:i - n] = False
                free_item[j:j - n] = False
                tiles.append((i, j, -n))
        if len(tiles) == marked:
            return tiles


class Block:
    """Some benchmark items: their words as numbers and the stretches they begin from."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.known: dict[str, int] = {}
        self.items = []
        for key, text in items:
            words = tokens(text)
            ids = np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.int64)
            self.items.append((key, ids))
        self.seed = seed
        self.starts = {}    # by length: sorted hashes of the stretches that bring an item in, and the item of each
        for least in sorted({self.least(ids) for _, ids in self.items} - {0}):
            own = [(i, ids) for i, (_, ids) in enumerate(self.items) if self.least(ids) == least]
            hashes = np.concatenate([rolling(ids, least) for _, ids in own])
            owner = np.repeat([i for i, _ in own], [len(ids) - least + 1 for _, ids in own])
            order = np.argsort(hashes, kind="stable")
            self.starts[least] = hashes[order], owner[order]

    def least(self, ids: np.ndarray) -> int:
        """Words of an item's shortest tile."""
        return min(self.seed, len(ids))

    def touched(self, ids: np.ndarray) -> list[int]:
        """Items that share a stretch of their shortest length with a document."""
        found = set()
        for least, (hashes, owner) in self.starts.items():
            if len(ids) < least:
                continue
            clear = np.convolve(ids != 0, np.ones(least, np.int64), "valid") == least
            own = np.unique(rolling(ids, least)[clear])
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for k in np.flatnonzero(high > low):
                found.update(owner[low[k]:high[k]].tolist())
        return sorted(found)

    def covered(self, ids: np.ndarray, coverage: float):
        """(item, its number of words, tiles) of each item that covers enough of itself in a document; short ones as a whole."""
        for at in self.touched(ids):
            key, words = self.items[at]
            tiles = greedy_tiles(ids, words, self.least(words))
            if sum(n for _, _, n in tiles) >= (coverage if len(words) >= self.seed else 1) * len(words):
                yield key, len(words), tiles


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark in blocks of bounded size; the rows are streamed to the driver, not held there."""
    held, size = [], 0
    for key, text in benchmark.filter(F.col(text_col).isNotNull()).select(item_col, F.col(text_col).cast("string")).toLocalIterator():
        held.append((key, text))
        size += text.count(" ") + 1
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(df: DataFrame, benchmark: DataFrame, seed=SEED, coverage=COVERAGE, id_col="doc_id", text_col="text",
                 item_col="item_id", item_text_col="text") -> DataFrame:
    """``id_col``, ``item_col``, ``coverage``, ``tiles``, ``covered``, ``item_words`` for each contaminated pair.

    An item is in a document if tiles of ``seed`` words or more cover
    ``coverage`` of it; items of fewer words must be there as a whole. Null and
    empty texts match nothing. Ids may be of any type. Repeated rows give
    repeated pairs; rows with null ids come out with null.
    Other columns are left out. The benchmark is a stated set of questions: each
    block of it meets all documents in one pass without a shuffle.
    """
    spark = df.sparkSession
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, coverage double, tiles int, covered int, item_words int"
    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))

    types = arrow_schema(schema)

    def matcher(block):
        def run(batches):
            import pyarrow as pa

            known = block()
            for batch in slices(batches):
                out = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item, words, tiles in known.covered(numbers(tokens(text), known.known), coverage):
                        covered = sum(n for _, _, n in tiles)
                        out.append((key, item, covered / words, len(tiles), covered, words))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)
        return run

    result = None
    for items in _blocks(benchmark, item_col, item_text_col):
        part = rows.mapInArrow(matcher(ship(spark, Block(items, seed), "tiles")), schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result


def keep(df: DataFrame, benchmark: DataFrame, seed=SEED, coverage=COVERAGE, text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """``df`` without the rows that are contaminated by an item."""
    def matcher(block):
        def decider():
            known = block()

            def clean(text):
                return not any(known.covered(numbers(tokens(text), known.known), coverage))

            return lambda texts: [clean(t) for t in texts]
        return decider

    for items in _blocks(benchmark, item_col, item_text_col):
        df = keep_rows(df, text_col, matcher(ship(df.sparkSession, Block(items, seed), "tiles")))
    return df
