"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import bpe, domtree, langid, partenum, sharding, syncmers, tiling, tokenfile, toxicity, warc  # noqa: E402
from colloquy.llm.common import scratch  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 5),
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 5),
    (2, "the CAT sat on the mat and looked at the moon for a while.", None, None, None),
    (3, None, "en", "b", None),
    (None, "a row without an id", "en", "b", 1),
    (None, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "fr", "b", 0),
    (6, LONG, "en", "c", len(LONG)),
    (7, "...", "en", "c", 3),
    (7, "zwölf Boxkämpfer 漢字 🙂  tabs\tand\n\nlines", "de", "c", 1),
    (8, "x", "en", "c", 1),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
KEPT = [-1, -1, 1, 3, 4, 5, 6, 7, 7, 8]
CLASH = ("_id", "_text", "_key", "_node", "ids", "node", "score", "label", "shard", "depth", "_hash", "_gone", "start", "fingerprint", "accepted")


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, COLUMNS)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def content(name):
    return Path(public_tokenizers.path(name)).read_bytes()


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (None, 1, "x"), (4, 0, "x")], "doc_id bigint, toxic int, _label string")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == len(ROWS)
    some = toxicity.train([("you idiot %d" % (i % 7), 1) for i in range(40)] + [("a kind day %d" % (i % 7), 0) for i in range(40)])
    rows = toxicity.score(docs, some).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score(nothing, some).count() == 0 and toxicity.keep(docs, some).columns == docs.columns
    assert toxicity.fit(nothing, labels).ratios is None and toxicity.keep(docs, toxicity.Model()).count() == len(ROWS)


def test_language(docs, nothing):
    model = langid.fit(docs)
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (7, "und", 0.0)} <= rows
    assert langid.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(nothing)).collect()} == {"und"}
    assert langid.keep(docs, model).filter("text is null").count() == 0


def test_jaccard(docs, nothing):
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in partenum.classes(docs, 4, 85, 100).collect())
    assert len(rows) == len(ROWS)
    assert [r for r in rows if r[0] in (1, 2)] == [(1, 11, 1), (1, 11, 1), (2, 11, 1)]
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 8), (-1, 0, None), (-1, 2, None)} <= set(rows)
    assert partenum.classes(nothing).count() == 0
    kept = partenum.keep_one(docs)
    assert kept.columns == docs.columns
    # Of rows alike in id and text one stays; a row that repeats an id with another text has a class of its own.
    assert sorted(r.doc_id or -1 for r in kept.collect()) == KEPT


def test_syncmers(docs, nothing):
    rows = syncmers.edited(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4)} == {""}
    assert syncmers.edited(nothing).count() == 0 and syncmers.fingerprints(docs).count() == len(ROWS)


def test_tokens(spark, docs, nothing):
    tokenizer = content("byte_bpe_50k.json").decode()
    folder = scratch(spark, "test-tokens")
    rows = tokenfile.read(spark, folder, tokenfile.write(docs, folder, tokenizer, public_tokenizers.PATTERN, end=0)).collect()
    assert len(rows) == len(ROWS)
    starts = sorted((r.start, len(r.ids) // 4) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    folder = scratch(spark, "test-no-tokens")
    assert tokenfile.read(spark, folder, tokenfile.write(nothing, folder, tokenizer)).count() == 0


def test_bpe(docs, nothing):
    ranks = content("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    texts = sorted(r.decoded for r in bpe.decode(encoded, ranks, as_text=True).collect())
    assert texts == sorted(r[1] or "" for r in ROWS)
    assert bpe.encode(nothing, ranks, public_tokenizers.PATTERN).count() == 0


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, "sat on the mat and looked at the moon", "x"), (2, None, "x"), (3, "", "x"), (4, "the mat", "x"), (None, LONG, "x")],
                                  "item_id bigint, text string, doc_id string")
    rows = sorted((r.doc_id, r.item_id or -1) for r in tiling.contaminated(docs, items).collect())
    assert rows == [(1, 1), (1, 1), (1, 4), (1, 4), (2, 1), (2, 4), (6, -1)]     # a short item must be there as a whole
    kept = tiling.keep(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert tiling.contaminated(nothing, items).count() == 0 and tiling.contaminated(docs, items.limit(0)).count() == 0


def test_shards(docs, nothing):
    rows = sharding.assign(docs, 200).select("doc_id", "shard", "depth", "shard_bytes", "overfull").collect()
    assert len(rows) == len(ROWS) and all(len(r.shard) == r.depth for r in rows)
    assert {r.doc_id for r in rows if r.overfull} == {6}
    assert sharding.assign(nothing, 200).count() == 0
    assert {r.shard for r in sharding.assign(docs, 1 << 30).select("shard").collect()} == {""}


def test_archives(spark, docs, nothing):
    warc.register(spark)
    for df in (docs, nothing):
        folder = scratch(spark, "test-warc")
        warc.archive(df, folder, "doc_id", "source", "text")
        rows = spark.read.format("warc").load(folder).collect()
        assert len(rows) == df.count()
    folder = scratch(spark, "test-warc")
    warc.archive(docs, folder, "doc_id", "source", "text")
    found = sorted((r.record_id, r.record_type, r.refers_to or "") for r in spark.read.format("warc").load(folder).collect())
    assert ("urn:row:3", "revisit", "urn:row:4") in found and ("urn:row:4", "response", "") in found
    assert found.count(("urn:row:1", "response", "")) == 2 and ("urn:row:null", "revisit", "urn:row:4") in found


def test_pages(spark, nothing):
    pages = spark.createDataFrame([(1, "u", "<article><p>One &amp; two</p>three</article>", "x"), (1, "u", "<article><p>One &amp; two</p>three</article>", "x"),
                                   (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>" * 3000 + "deep", "x"), (4, "u", "<script>never closed", "x"),
                                   (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<a <b> &#x; </", "x")], "page_id bigint, url string, html string, text string")
    model = domtree.fit(pages)
    rows = domtree.extract(pages, model).collect()
    assert len(rows) == 8 and [r.text for r in rows if r.page_id == 2] == [""]
    assert domtree.extract(pages.limit(0), model).count() == 0 and domtree.fit(pages.limit(0)).weights
    assert domtree.Model({"t:p": 9.0}).text("<article><p>One &amp;  two</p><p>three</article>") == "One & two\nthree"


def test_stages(spark, docs, nothing):
    for df in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            rows = out.count()
            assert rows <= df.count(), name
            if name != "bpe":
                assert out.columns == df.columns, name
