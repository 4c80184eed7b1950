"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into words of letters. Each stretch of two to
four letters of a word, with marks at its ends, is hashed to a bucket; a text
is the mean of its buckets' embeddings, classified by a linear softmax. Both
are trained together by stochastic gradient descent. A held-back part of the
labelled rows gives the temperature of the probabilities and the score below
which a text is rejected.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import keep_rows, once, ship, slices

BUCKET_BITS, DIM, EPOCHS, RATE = 15, 16, 6, 1.0
ROWS_PER_LANGUAGE = 500     # labelled texts that a model is fitted on, of each language at most
TRAIN_CHARS = 20_000        # longer texts are no examples
PRECISION = 0.97            # of accepted texts, on the held-back rows
UNKNOWN = "und"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def subwords(text: str) -> np.ndarray | None:
    """Buckets of a text's subwords; None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = once("language", "letters", 0, _letters)
    letter = table[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    for i in far.tolist():
        letter[i] = chr(int(codes[i])).isalpha()
    if not letter.any():
        return None
    marked = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
    kept = np.ones(len(marked), bool)
    kept[1:] = (marked[1:] != 0) | (marked[:-1] != 0)
    marked = marked[kept]
    inner = marked == 0
    two = marked[:-1] * _GOLD + marked[1:] + np.uint64(2)
    found = [two]
    if len(marked) > 2:
        three = two[:-1] * _GOLD + marked[2:]
        found.append(three[~inner[1:-1]])
    if len(marked) > 3:
        four = three[:-1] * _GOLD + marked[3:]
        found.append(four[~(inner[1:-2] | inner[2:-1])])
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(32))) * _GOLD
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _softmax(z):
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


class Model:
    """``languages``; ``table``: what each bucket adds to the mean logits; temperature and threshold."""

    def __init__(self, languages, table, bias, temperature=1.0, threshold=0.0):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.threshold = temperature, threshold

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets = subwords(text) if text else None
        if buckets is None or not self.languages:
            return UNKNOWN, 0.0
        # In steps, so that a long text needs no more memory than a short one.
        total = sum(self.table[buckets[at:at + 65536]].sum(0) for at in range(0, len(buckets), 65536))
        p = _softmax((total / len(buckets) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def accepts(self, text: str | None) -> bool:
        language, score = self.predict(text)
        return language != UNKNOWN and score >= self.threshold


def train(rows: list[tuple[str, str]], seed=0) -> Model:
    """Fit on (text, language) rows; the same rows give the same model. No rows: a model that rejects everything."""
    rows = [(t, l) for t, l in sorted(rows) if t and subwords(t) is not None]
    languages = sorted({l for _, l in rows})
    if not languages:
        return Model([], None, None)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[::5]] if len(rows) >= 5 * len(languages) else []
    fitted = [rows[i] for i in order if not held or i not in set(order[::5].tolist())]

    def examples(source):
        """Each text, and a short stretch of it, so that short texts are learnt as well."""
        found = []
        for text, language in source:
            y = languages.index(language)
            words = text.split()
            at, n = int(rng.integers(0, max(1, len(words) - 5))), int(rng.integers(1, 12))
            for part in (text, " ".join(words[at:at + n])):
                if (b := subwords(part)) is not None:
                    found.append((*np.unique(b, return_counts=True), y))
        return found

    sample = examples(fitted)
    weight = np.bincount([y for *_, y in sample], minlength=len(languages))
    weight = len(sample) / (len(languages) * np.maximum(weight, 1))
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    steps, step = EPOCHS * len(sample), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sample)):
            b, n, y = sample[i]
            share = (n / n.sum())[:, None]
            mean = (embed[b] * share).sum(0)
            slope = _softmax(mean @ out + bias)
            slope[y] -= 1
            slope *= RATE * (1 - step / steps) * min(weight[y], 4.0)
            back = out @ slope
            out -= np.outer(mean, slope)
            bias -= 0.1 * slope
            embed[b] -= share * back * len(b) ** 0.5
            step += 1
    model = Model(languages, (embed @ out).astype(np.float32), bias)
    if held:
        checks = examples(held)
        logits = np.array([(n / n.sum()) @ model.table[b] + bias for b, n, _ in checks])
        right = np.array([y for *_, y in checks])
        losses = [(-np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean(), t) for t in np.geomspace(0.05, 20, 60)]
        model.temperature = float(min(losses)[1])
        p = _softmax(logits / model.temperature)
        score, hit = p.max(1), p.argmax(1) == right
        order = np.argsort(-score, kind="stable")
        precision = np.cumsum(hit[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(precision >= PRECISION)
        model.threshold = float(score[order[enough[-1]]]) if len(enough) else 0.0     # no score tells: none is rejected for it
    return model


def fit(df: DataFrame, text_col="text", lang_col="lang", key_col="doc_id", rows_per_language=ROWS_PER_LANGUAGE, train_chars=TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows: ``rows_per_language`` of each language, of up to ``train_chars`` characters, spread over the table by a hash of the key."""
    rows = df.filter(F.col(lang_col).isNotNull() & (F.length(text_col) <= train_chars) & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return train([])
    share = F.create_map(*(F.lit(x) for language, n in counts.items() for x in (language, min(1e6, 1e6 * rows_per_language / n))))[F.col(lang_col)]
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(key_col), F.lit("language")), F.lit(1_000_000)) < share)
    return train([(r[0], r[1]) for r in chosen.select(text_col, lang_col).limit(2 * rows_per_language * len(counts)).collect()])


def identify(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``accepted`` for every whole text.

    Null texts and texts without a letter are ``und`` with score 0 and not
    accepted; others get the likeliest learnt language and are accepted from
    the model's threshold on. Repeated rows come out as often as they are;
    other columns are left out. One pass, no shuffle.
    """
    shared = ship(df.sparkSession, model, "language")  # 2^15 buckets: a size that is fixed

    def run(batches):
        import pyarrow as pa

        known = shared()
        for batch in slices(batches):
            found = [known.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([l for l, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
                pa.array([l != UNKNOWN and s >= known.threshold for l, s in found], pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def keep(df: DataFrame, model: Model, text_col="text") -> DataFrame:
    """``df`` without the rows that are rejected: no letter, or a score below the model's threshold.

    A model that has learnt no language rejects nothing.
    """
    if not model.languages:
        return df
    shared = ship(df.sparkSession, model, "language")

    def decider():
        known = shared()
        return lambda texts: [known.accepts(t) for t in texts]

    return keep_rows(df, text_col, decider)
