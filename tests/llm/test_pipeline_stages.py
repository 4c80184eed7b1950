"""Each stage of the pipeline against a plain version of what it keeps."""

import re
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import bpe, langid, toxicity  # noqa: E402
from colloquy.llm.common import table  # noqa: E402
from test_methods import plain_classes  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def kept(spark, docs, stage):
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns
    return {r.doc_id for r in found.select("doc_id").collect()}


def test_toxicity(spark, docs, texts):
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    tools = model.compressors() if model.ratios is not None else None
    one_by_one = {k: float(model.scores([t or ""], tools)[0]) for k, t in texts.items()}
    assert kept(spark, docs, corpus_pipeline.drop_toxic) == {k for k, s in one_by_one.items() if s < 0.3}


def test_language(spark, docs, texts):
    model = langid.fit(docs)
    accepted = {k for k, t in texts.items() if (found := model.predict(t))[0] != "und" and found[1] >= model.threshold}
    assert kept(spark, docs, corpus_pipeline.drop_unknown_language) == accepted and len(accepted) > 0.9 * len(texts)
    unlabelled = docs.drop("lang").selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert corpus_pipeline.drop_unknown_language(spark, unlabelled, SF).count() == docs.count()


def test_near_duplicates(spark, docs, texts):
    assert kept(spark, docs, corpus_pipeline.drop_near_duplicates) == {k for k, (_, head) in plain_classes(texts, 5, 80, 100).items() if k == head}


def longest(doc, item, free_doc, free_item):
    best = (0, 0, 0)
    for j in range(len(item)):
        for i in range(len(doc)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_doc[i + n] and free_item[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def covered(doc, item):
    """Words of an item that greedy tiles of five words or more cover, by looking at all places."""
    free_doc, free_item, total = [True] * len(doc), [True] * len(item), 0
    while True:
        n, i, j = longest(doc, item, free_doc, free_item)
        if n < 5:
            return total
        free_doc[i:i + n], free_item[j:j + n] = [False] * n, [False] * n
        total += n


def test_decontamination(spark, docs, texts):
    items = [re.findall(r"\w+", r.text.lower()) for r in table(spark, SF, "benchmark").collect()]
    grams = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in items]
    hit = set()
    for key, text in texts.items():
        words = re.findall(r"\w+", (text or "").lower())
        own = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        if any(own & g and 2 * covered(words, item) >= len(item) for item, g in zip(items, grams)):
            hit.add(key)
    assert hit and kept(spark, docs, corpus_pipeline.drop_benchmark) == set(texts) - hit


def test_ids(spark, docs, texts):
    import tiktoken

    ranks = bpe.read_ranks(Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.token_ids(spark, docs, SF).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: plain.encode_ordinary(t or "") for k, t in texts.items()}
    assert all(n == len(ids) for n, ids in got.values())
