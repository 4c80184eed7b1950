"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one
on what toxic texts have far more often: stretches of words, whole words and
phrases. Most of a toxic text is ordinary, so a dictionary trained on all its
windows tells next to nothing (the README has figures). A text is cut into windows of whole words; each window is compressed with the
ordinary dictionary alone and with the toxic one before it. How many bytes the
toxic dictionary saves is the window's distance. Log-likelihood ratios of the
distances, learnt from labelled texts that trained neither dictionary, are
summed over all windows of a text, and over the stretch of windows where their
sum is largest: clean text takes nothing from the stretch. Both sums are
calibrated and the higher decides: 0.3 is where the held-back labelled texts are
told apart best.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import keep_rows, once, ship, slices

WINDOW = 20                 # bytes of a window, unless one word is longer
HEAD = 4                    # bytes of a word that are its begin
GRAMS = (5, 6, 7, 8)        # bytes of the stretches that mark toxic text
RUN = 4                     # words of the longest phrase that marks it
PASSAGE = 64                # bytes of a passage
LEVELS = ((1.5, 3.0), (1.0, 2.5), (0.5, 2.0))  # log ratio of their shares of texts, standard errors below the estimate
ORDINARY_BYTES = 16_384     # of the ordinary dictionary
TOXIC_BYTES = 32_768        # of the toxic one, at most
TOXIC_ROWS, ORDINARY_ROWS = 2_000, 4_000   # labelled texts that a model is fitted on, at most
TRAIN_CHARS = 20_000        # longer texts are no examples
WINDOW_BYTES = 3_000_000    # of ordinary windows that the ordinary dictionary is trained on; the trainer keeps some kilobytes of them
TAIL = 32                   # bytes of the ordinary dictionary after each window
REACH = 12                  # distances beyond count as this
CUT = 0.3
_WINDOW = re.compile(rb" .{1,%d}(?= |\Z)| [^ ]+" % (WINDOW - 1), re.S)


def words(text: str) -> bytes:
    """Lower-cased words, each after one blank, their first bytes in capitals: a word's begin is matched by begins only."""
    found = text.lower().encode("utf-8", "surrogatepass").split()
    return b"".join([b" " + w[:HEAD].upper() + w[HEAD:] for w in found])


def windows(text: str) -> list[bytes]:
    return _WINDOW.findall(words(text))


def _grams(data: bytes, n: int) -> np.ndarray:
    """Distinct stretches of ``n`` bytes, 8 at most, as numbers."""
    raw = np.frombuffer(data + b" ", np.uint8).astype(np.uint64)
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(raw) - n + 1, np.uint64)
    for i in range(n):
        h = h << np.uint64(8) | raw[i:len(raw) - n + 1 + i]
    return np.unique(h)


def _word_runs(words_: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all stretches of ``n`` words, given as numbers."""
    h = np.zeros(max(0, len(words_) - n + 1), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words_[i:len(words_) - n + 1 + i]
    return h


def _evidence(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of toxic texts, in how many of them, the log ratio of both classes' shares of texts, its standard error."""
    (gt, nt), (go, no) = (np.unique(np.concatenate(c), return_counts=True) for c in (toxic, ordinary))
    at = np.minimum(np.searchsorted(go, gt), len(go) - 1)
    other = np.where(go[at] == gt, no[at], 0) if len(go) else np.zeros(len(gt), np.int64)
    ratio = np.log((nt + 1) / len(toxic)) - np.log((other + 1) / len(ordinary))
    return gt, nt, ratio, np.sqrt(1 / (nt + 1) + 1 / (other + 1))


def _toxic_passages(toxic: list[str], ordinary: list[str]):
    """For each of LEVELS the passages that toxic texts have far more often, and in how many of them.

    Passages are stretches within a word, whole words, and phrases of up to
    RUN words that say more than each shorter run of words in them.
    """
    toxic, ordinary = [words(t) for t in toxic], [words(t) for t in ordinary]
    grams = {n: _evidence([_grams(t, n) for t in toxic], [_grams(t, n) for t in ordinary]) for n in GRAMS}
    known: dict[bytes, int] = {}
    numbered = [[np.array([known.setdefault(w, len(known) + 1) for w in t.split()], np.uint64) for t in side] for side in (toxic, ordinary)]
    del known
    runs = {n: _evidence(*([np.unique(_word_runs(t, n)) for t in side] for side in numbered)) for n in range(1, RUN + 1)}
    for far_more, sure in LEVELS:
        passages: dict[bytes, int] = {}
        marks = {n: {int(g).to_bytes(n, "big") for g in found[(ratio - sure * error > far_more) & (count > 1)]} for n, (found, count, ratio, error) in grams.items()}
        for text in toxic:
            own = set()
            for word in text.split():
                word = b" " + word + b" "
                on = [(i, i + n) for n in GRAMS for i in range(len(word) - n + 1) if word[i:i + n] in marks[n]]
                if on:
                    begin, end = min(on)[0], max(e for _, e in on)
                    own.update(word[i:min(end, i + PASSAGE)] for i in range(begin, end, PASSAGE))
            for passage in own:
                passages[passage] = passages.get(passage, 0) + 1
        lows: dict[bytes, float] = {}
        for n, (found, count, ratio, error) in runs.items():
            low = ratio - sure * error
            at = np.flatnonzero((low > far_more) & (count > 1))
            marked = {int(found[i]): (float(low[i]), int(count[i])) for i in at}
            for text, numbers in zip(toxic, numbered[0]):
                hashes = _word_runs(numbers, n)
                hits = np.flatnonzero(np.isin(hashes, found[at]))
                if not len(hits):
                    continue
                split = text.split()
                for i in hits.tolist():
                    mark = marked.pop(int(hashes[i]), None)
                    if mark is None:
                        continue
                    own = split[i:i + n]
                    parts = [b" ".join(own[x:y]) for x in range(n) for y in range(x + 1, n + 1) if y - x < n]
                    if all(mark[0] > lows.get(p, -np.inf) for p in parts):
                        run = b" ".join(own)
                        lows[run] = mark[0]
                        passage = (b" " + run + b" ")[:PASSAGE]
                        passages[passage] = max(passages.get(passage, 0), mark[1])
        yield passages


def _toxic_dictionary(passages: dict[bytes, int]) -> bytes:
    """Trained by zstandard on the passages, each as often as toxic texts have it; what the trainer left out stands first."""
    import random

    import zstandard

    order = sorted(passages, key=lambda p: (passages[p], p))
    samples = [p for p in order for _ in range(passages[p])]
    size = min(TOXIC_BYTES, max(256, sum(map(len, order)))) + 256    # and the trainer's own tables
    # The trainer wants about a hundred times as many bytes as it keeps, in no order.
    samples *= 1 + 100 * size // max(1, sum(map(len, samples)))
    random.Random(0).shuffle(samples)
    try:
        trained = zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too little to train on: the passages themselves
        trained = b""
    missing, room = [], TOXIC_BYTES + 512 - len(trained)
    for passage in reversed(order):
        if passage.strip() not in trained and len(passage) <= room:
            missing.append(passage)
            room -= len(passage)
    return b"".join(reversed(missing)) + trained


def _ordinary_dictionary(texts: list[str]) -> bytes:
    import zstandard

    samples, size = [], 0
    for text in texts:
        for window in windows(text):
            if size < WINDOW_BYTES:
                samples.append(window)
                size += len(window)
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-ORDINARY_BYTES:]


class Model:
    def __init__(self, ordinary=b"", toxic=b"", ratios=None, slope=0.0, centre=0.0, stretch=0.0):
        self.ordinary, self.toxic, self.ratios, self.slope, self.centre, self.stretch = ordinary, toxic, ratios, slope, centre, stretch

    def compressors(self):
        import zstandard

        def made(content):
            params = zstandard.ZstdCompressionParameters.from_level(
                3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                strategy=zstandard.STRATEGY_LAZY, search_log=4, min_match=4, window_log=17, hash_log=17, chain_log=17)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=params)

        # The ordinary dictionary begins both, at equal distances, before bytes that no text has or toxic passages: only
        # these make a difference, and being the nearest they are found before the ordinary places of their words.
        return made(self.ordinary + (b"\xff\xfe" * len(self.toxic))[:len(self.toxic)]), made(self.ordinary + self.toxic)

    def distances(self, texts: list[str], compressors):
        """Per window its distance, from 0 for -REACH on, and per text its number of windows; for a few texts at a time."""
        tail = self.ordinary[-TAIL:]  # compressible with both, so that no window is stored as it is
        begin = 0
        while begin < len(texts):
            held, owners, end, size = [], [], begin, 0
            while end < len(texts) and size < 1 << 20:  # bounded, whatever the texts' lengths
                own = [w + tail for w in windows(texts[end])]
                held += own
                owners.append(len(own))
                size += len(texts[end])
                end += 1
            saved = np.zeros(0, np.int64)
            if held:
                lengths = [np.fromiter(map(len, c.multi_compress_to_buffer(held)), np.int64, len(held)) for c in compressors]
                saved = np.clip(lengths[0] - lengths[1], -REACH, REACH) + REACH
            yield saved, np.array(owners, np.int64)
            begin = end

    def sums(self, parts) -> np.ndarray:
        """Per text the sum of log ratios over all windows, and that over the stretch of windows where it is largest, at least 0."""
        out = []
        for saved, owners in parts:
            sums = np.concatenate([[0.0], np.cumsum(self.ratios[saved])])
            ends = np.cumsum(owners)
            for first, last in zip(ends - owners, ends):
                run = sums[first:last + 1]
                out.append((run[-1] - run[0], (run - np.minimum.accumulate(run)).max()))
        return np.array(out).reshape(-1, 2)

    def scores(self, texts: list[str], compressors) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(texts))
        z = self.slope * (self.sums(self.distances(texts, compressors)) - [self.centre, self.stretch]).max(1) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: list[tuple[str, int]], weight: float = 1.0) -> Model:
    """Fit on (text, toxic) rows; ``weight``: ordinary texts that each ordinary row stands for, over toxic ones per toxic row.

    Two thirds of the rows of each class make the dictionaries, the others the
    ratios and the calibration. Without both classes every score is 0.
    """
    import random

    rows = sorted((t, int(y)) for t, y in rows if t)
    random.Random(0).shuffle(rows)
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model()
    half_t, half_o = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    y = np.arange(len(toxic) - half_t + len(ordinary) - half_o) < len(toxic) - half_t
    mass = np.where(y, 1.0, max(weight, 1e-9))
    own, best, best_f1 = _ordinary_dictionary(ordinary[:half_o]), Model(), 0.0
    for passages in _toxic_passages(toxic[:half_t], ordinary[:half_o]):  # the evidence that tells the held-back rows apart best
        if passages:
            model, f1 = calibrate(Model(own, _toxic_dictionary(passages)), toxic[half_t:] + ordinary[half_o:], y, mass)
            if f1 > best_f1:
                best, best_f1 = model, f1
    return best


def calibrate(model: Model, texts: list[str], y: np.ndarray, mass: np.ndarray) -> tuple[Model, float]:
    """Ratios, cut and slope of ``model`` by held-back texts, and its F1 value on them."""
    seen = list(model.distances(texts, model.compressors()))
    saved, of = np.concatenate([p[0] for p in seen]), np.repeat(y, np.concatenate([p[1] for p in seen]))
    p1, p0 = (np.bincount(saved[side], minlength=2 * REACH + 1) + 1.0 for side in (of, ~of))
    model.ratios = np.log(p1 / p1.sum()) - np.log(p0 / p0.sum())
    sums = model.sums(seen)

    def cut(total, counted, lowest=False):
        """The best F1 value if texts from a cut on are toxic besides those ``counted``, and the cut, in the middle of the gap below it."""
        order = np.argsort(-total, kind="stable")
        m, yes, total = np.where(counted, 0, mass)[order], y[order], total[order]
        hit, taken = mass[counted & y].sum() + np.cumsum(m * yes), mass[counted].sum() + np.cumsum(m)
        f1 = 2 * hit / (taken + mass[y].sum())
        f1[:-1][total[:-1] == total[1:]] = -1     # equal texts are not cut apart
        at = int(np.flatnonzero(f1 == f1.max())[-1 if lowest else 0])
        return float(f1[at]), float((total[at] + (total[at + 1] if at + 1 < len(total) else total[at] - 2)) / 2)

    _, model.centre = cut(sums[:, 0], np.zeros(len(y), bool))
    # Besides, a stretch is enough, however long the clean text around it, from where that costs nothing on the held-back rows.
    f1, model.stretch = cut(sums[:, 1], sums[:, 0] >= model.centre, lowest=True)
    total = (sums - [model.centre, model.stretch]).max(1)
    slope, z0 = 0.1, np.log(CUT / (1 - CUT))
    for _ in range(200):  # logistic slope with the cut held
        p = 1 / (1 + np.exp(-np.clip(slope * total + z0, -30, 30)))
        slope += 0.5 * (mass * (y - p) * total).sum() / ((mass * p * (1 - p) * total ** 2).sum() + 1e-6)
        slope = float(np.clip(slope, 0.05, 5.0))
    model.slope = slope
    return model, f1


def fit(documents: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
        toxic_rows=TOXIC_ROWS, ordinary_rows=ORDINARY_ROWS, train_chars=TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of labelled documents of up to ``train_chars`` characters, spread over the table by a hash of the id."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    marked = marked.groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = {r[0]: r[1] for r in marked.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return Model()
    share = F.when(F.col("_label") == 1, F.lit(1e6 * min(1, toxic_rows / counts[1]))).otherwise(F.lit(1e6 * min(1, ordinary_rows / counts[0])))
    chosen = marked.filter(F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1_000_000)) < share)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")) \
        .filter((F.length("_text") <= train_chars) & (F.length("_text") > 0))
    rows = texts.join(F.broadcast(chosen.limit(2 * (toxic_rows + ordinary_rows))), "_id").select("_text", "_label") \
        .limit(2 * (toxic_rows + ordinary_rows)).collect()
    # What one ordinary row stands for, over what one toxic row stands for.
    used = [sum(r[1] == k for r in rows) or 1 for k in (0, 1)]
    return train([(r[0], r[1]) for r in rows], (counts[0] / used[0]) / (counts[1] / used[1]))


def score(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col``, ``score``, ``predicted`` (1 from 0.3 on) for every whole text.

    Null and empty texts have no window and get the score of a sum of 0; without a usable model every score is 0. Repeated rows come out as
    often as they are; other columns are left out. One pass, no shuffle.
    """
    shared = ship(df.sparkSession, model, "toxicity")  # two dictionaries: a size that is fixed
    name = hash((model.ordinary, model.toxic))

    def run(batches):
        import pyarrow as pa

        known = shared()
        tools = once("toxicity", "compressors", name, known.compressors) if known.ratios is not None else None
        for batch in slices(batches):
            found = known.scores([t or "" for t in batch.column(1).to_pylist()], tools)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= CUT).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep(df: DataFrame, model: Model, text_col="text") -> DataFrame:
    """``df`` without the rows that score 0.3 or more."""
    shared, name = ship(df.sparkSession, model, "toxicity"), hash((model.ordinary, model.toxic))

    def decider():
        known = shared()
        if known.ratios is None:
            return lambda texts: [True] * len(texts)
        tools = once("toxicity", "compressors", name, known.compressors)
        return lambda texts: known.scores([t or "" for t in texts], tools) < CUT

    return keep_rows(df, text_col, decider)
