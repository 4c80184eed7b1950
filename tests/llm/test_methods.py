"""The operators against plain versions, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import bpe, domtree, langid, partenum, sharding, syncmers, tiling, tokenfile, toxicity, warc  # noqa: E402
from colloquy.llm.common import scratch, table  # noqa: E402
from colloquy.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_sql(spark):
    from compare import connection, spark_rows, sql_rows

    tables = connection(SF)
    for name, sql in ORACLES.items():
        assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(tables, sql), name


def plain_classes(texts, n, num, den):
    sets, root = {}, {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[key] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        root[key] = key

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and find(a) != find(b):
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_ngram_jaccard"](spark, SF).collect()}
    assert got == plain_classes(texts, 4, 85, 100)


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard_in_families(spark, monkeypatch, block):
    """A family of near copies that differ at random, short texts among them, in small and large blocks."""
    monkeypatch.setattr(partenum, "BLOCK", block)
    rng, texts = random.Random(block), {}
    for size in (3, 9, 14, 60):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
        for _ in range(40):
            own = base[:]
            for _ in range(rng.randrange(0, 1 + size // 10)):
                own[rng.randrange(size)] = f"w{rng.randrange(10 ** 6)}"
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for n, num, den in ((2, 80, 100), (4, 85, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.classes(df, n, num, den).collect()}
        assert got == plain_classes(texts, n, num, den)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for size in [*range(1, 40), 100, 333, 1000]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = rng.integers(0, 1 + int(0.2 * len(a)))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, 1 + int(0.1 * len(a)))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                (sa, na), (sb, nb) = partenum.signatures(a, 80, 100), partenum.signatures(b, 80, 100)
                assert np.intersect1d(sa, sb).size >= max(na, nb)


def test_bpe_as_the_library(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    content = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(content), special_tokens={})
    want = {}
    for key, text in texts.items():
        ids = library.encode_ordinary(text or "")
        want[key] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe_round_trip"](spark, SF).collect()} == want
    encode = bpe.Transducer(bpe.read_ranks(content))
    rng = random.Random(2)
    for _ in range(3000):  # twice: moves met first are read through, met again they are made
        piece = "".join(rng.choice("aabehinst éü漢🙂") for _ in range(rng.randrange(1, 20))).strip() or "x"
        plain = b"".join(encode.ranks[t].to_bytes(4, "little") for t in bpe.merge(piece.encode(), encode.ranks))
        assert encode(piece) == plain and encode(piece) == plain and encode(piece) == plain


def test_stream_decoder():
    tokens = [bytes((i,)) for i in range(256)]
    rng = random.Random(3)
    for data in ["aé漢🙂z".encode() * 3, b"\xe0\x80\xc3(\xf0\x9f\x99", bytes(rng.randrange(256) for _ in range(500)), "é".encode()[:1]]:
        for step in (1, 2, 3, 7):
            stream = bpe.StreamDecoder(tokens)
            out = "".join(stream.feed(data[i:i + step]) for i in range(0, len(data), step)) + stream.close()
            assert out == data.decode("utf-8", "replace")


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, start, want = Tokenizer.from_file(path), 0, {}
    for key in sorted(texts):
        ids = library.encode(texts[key] or "", add_special_tokens=False).ids + [0]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_records"](spark, SF).collect()} == want
    folder = scratch(spark, "test-records")
    manifest = tokenfile.write(table(spark, SF, "documents"), folder, Path(path).read_text(), public_tokenizers.PATTERN, end=0, files=3)
    first = manifest.orderBy("part").first()
    key, ids = tokenfile.record_at(folder, first.file, 1)
    assert (key, len(ids)) == (sorted(texts)[1], want[sorted(texts)[1]][1])
    import io

    damaged = bytearray(tokenfile.frame(b"body"))
    damaged[13] ^= 1
    with pytest.raises(ValueError):
        tokenfile.unframe(io.BytesIO(bytes(damaged)))


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op4_syncmer_fingerprints"](spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for i, key in enumerate(order):
        text, following = texts[key] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 3
        other = text[:len(text) - cut] + following[:cut]
        row = got[key]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        own, new, after = (syncmers.sketch(syncmers.anchors(t)[1]) for t in (text, other, following))
        assert row.fingerprint == syncmers.to_string(own) and row.near_edited == syncmers.likeness(own, new) and row.near_next == syncmers.likeness(own, after)


def test_anchors_are_closed_syncmers():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    at, hashes = syncmers.anchors(text)
    assert 0.18 < len(at) / len(text) < 0.27
    for i in at[:50].tolist():  # free of context: the stretch alone is chosen too
        alone = syncmers.anchors(text[i:i + syncmers.K])
        assert alone[0].tolist() == [0] and alone[1][0] == hashes[list(at).index(i)]
    other = "".join(rng.choice("qrstuvwxyz") for _ in range(500)) + text[1000:2000]
    begin, there, length = max(syncmers.align(text, other), key=lambda s: s[2])
    assert abs(begin - 1000) < 30 and there - begin == -500 and length > 900


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    documents = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op6_language"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_toxicity_held_out():
    rng = random.Random(5)
    words = ["".join(rng.choice(("an", "er", "st", "on", "the", "ly", "re")) for _ in range(rng.randint(1, 4))) for _ in range(3000)]

    def text(toxic):
        out = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        for _ in range(max(1, len(out) // 60) if toxic else 0):
            out[rng.randrange(len(out))] = rng.choice(("idiot", "moron", "scum", "loser"))
        return " ".join(out)

    model = toxicity.train([(text(i % 4 == 0), int(i % 4 == 0)) for i in range(800)])
    fresh = [(text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    scores = model.scores([t for t, _ in fresh], model.compressors())
    assert np.mean((scores >= toxicity.CUT) == [y for _, y in fresh]) > 0.95
    assert model.scores([""], model.compressors())[0] < toxicity.CUT


def plain_tiles(doc, item, least):
    """Greedy string tiling as it is written down: compare everything."""
    free_d, free_i, tiles = [x != 0 for x in doc], [x != 0 for x in item], []
    while True:
        best = []
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n >= least:
                    best.append((-n, j, i))
        if not best:
            return tiles
        longest = min(best)[0]
        for n, j, i in sorted(b for b in best if b[0] == longest):
            if all(free_d[i:i - n]) and all(free_i[j:j - n]):
                free_d[i:i - n] = [False] * -n
                free_i[j:j - n] = [False] * -n
                tiles.append((i, j, -n))


def test_tiles():
    rng = random.Random(6)
    for _ in range(150):
        doc, item = ([rng.randrange(0, 6) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert tiling.greedy_tiles(np.array(doc, np.int64), np.array(item, np.int64), 3) == plain_tiles(doc, item, 3)


def test_reordered_passages_are_found(spark):
    item = [f"w{i}" for i in range(40)]
    moved = item[20:] + ["between"] * 5 + item[:20]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(item[:8] + ["other"] * 50)), (3, "x " * 50 + " ".join(item))], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (10, "nothing of this is there at all")], "item_id bigint, text string")
    rows = sorted((r.doc_id, r.item_id, r.coverage, r.tiles) for r in tiling.contaminated(docs, items).collect())
    assert rows == [(1, 9, 1.0, 2), (3, 9, 1.0, 1)]
    assert [r.doc_id for r in tiling.keep(docs, items).collect()] == [2]


def test_sum_product_is_exact():
    """Marginals against summing over all labellings of a small tree."""
    from itertools import product
    from math import exp

    nodes, _ = domtree.parse("<body><div class=ad><p>a b</p></div><article><h1>t</h1><p>one, two.</p></article></body>")
    found = domtree.features(nodes)
    rng = random.Random(7)
    model = domtree.Model({f: rng.uniform(-1, 1) for own in found for f in own}, [[0.7, -0.4], [-0.9, 0.6]])
    odds, _, _ = model.marginals(nodes, found)
    total, one = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        score = sum(sum(model.weights[f] for f in found[i]) for i in range(len(nodes)) if labels[i])
        score += sum(model.pair[labels[nodes[i].parent]][labels[i]] for i in range(1, len(nodes)))
        total += exp(score)
        for i in range(len(nodes)):
            one[i] += exp(score) * labels[i]
    assert all(abs(1 / (1 + exp(-odds[i])) - one[i] / total) < 1e-9 for i in range(len(nodes)))


def test_main_text(spark):
    """Held-out pages: the article as its tags mark it, cut out by a plain pattern."""
    import html

    pages = table(spark, SF, "pages").collect()
    model = domtree.train([p.html for p in pages[::2]])
    for page in pages[1::2]:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert model.text(page.html) == "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_shards_of_small_limits(spark, texts):
    df = table(spark, SF, "documents")
    rows = sharding.assign(df, 20_000).collect()
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + len((r.text or "").encode())
    assert all(r.shard_bytes == sizes[r.shard] and (r.overfull == (sizes[r.shard] > 20_000)) for r in rows)
    shards = set(sizes)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for shard in shards:  # no split without need
        parent = shard[:-1]
        assert shard == "" or sum(n for s, n in sizes.items() if s.startswith(parent)) > 20_000


def test_archive_filters(spark, tmp_path):
    warc.register(spark)
    folder = scratch(spark, "test-filters")
    warc.archive(table(spark, SF, "pages").unionByName(table(spark, SF, "pages").selectExpr("page_id + 1000 AS page_id", "url", "html")), folder)
    df = spark.read.format("warc").load(folder)
    assert df.filter("record_type = 'revisit'").count() == df.filter("record_type = 'response'").count() == 50
    assert df.filter("record_type = 'revisit' and payload is not null").count() == 0
    assert df.filter("target_uri like 'https%' and record_type in ('response', 'other')").count() > 0
    bare = spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'response'")
    assert bare.filter("payload is null and payload_length > 0").count() == 50
    # Archives of other writers: plain, and gzip members without a length.
    import gzip

    row = {"record_id": "urn:row:1", "record_type": "response", "target_uri": "http://x", "date": "1970-01-01T00:00:00Z", "payload_digest": None,
           "refers_to": None, "payload_length": None, "payload": b"some <html>"}
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(warc.record(row) * 2)
    (other / "b.warc.gz").write_bytes(gzip.compress(warc.record(row)) * 3)
    rows = spark.read.format("warc").load(str(other)).collect()
    assert len(rows) == 5 and {bytes(r.payload) for r in rows} == {b"some <html>"}
