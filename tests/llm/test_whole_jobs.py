"""Cases that an operator must not leave out: one test for each."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import bpe, partenum, pretokens, tiling, tokenfile, toxicity, warc  # noqa: E402


def scores(model, texts):
    return model.scores(texts, model.compressors())


def test_toxic_phrases_of_ordinary_words():
    """Each word is as common in ordinary texts; only their order marks the toxic ones."""
    rng = random.Random(4)
    phrase = ["walk", "into", "the", "river"]
    others = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "sun") for b in ("ka", "ron", "del", "vis", "po", "ham")]

    def text(toxic):
        own = [rng.choice(others) for _ in range(60)]
        at = rng.randrange(50)
        if toxic:
            own[at:at] = phrase
        else:
            for word in phrase:
                own.insert(rng.randrange(len(own)), word)
        return " ".join(own)

    model = toxicity.train([(text(y), y) for y in [1] * 150 + [0] * 450])
    found = [scores(model, [text(y) for _ in range(100)]) >= toxicity.CUT for y in (1, 0)]
    assert np.mean(found[0]) > 0.8 and np.mean(found[1]) < 0.2


def test_one_toxic_sentence_in_a_very_long_text():
    rng = random.Random(6)
    bad = ["idiot", "moron", "scum", "trash"]
    some = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "sun", "gra") for b in ("ka", "ron", "del", "vis", "po", "ham", "lin")]

    def text(n, toxic):
        own = [rng.choice(some) for _ in range(n)]
        for _ in range(n // 40 if toxic else 0):
            own.insert(rng.randrange(n), rng.choice(bad))
        return " ".join(own)

    model = toxicity.train([(text(rng.randrange(80, 400), i % 4 == 0), int(i % 4 == 0)) for i in range(600)])
    clean = text(20_000, False)
    words = clean.split()
    words[9_000:9_000] = "you idiot and moron you scum and trash you idiot you moron".split()
    assert (scores(model, [clean, " ".join(words)]) >= toxicity.CUT).tolist() == [False, True]


def test_archives_of_other_writers():
    """All records of an archive gzipped as one file, or in members that cut records; errors where it ends too early."""
    rng = random.Random(7)
    row = lambda i: {"record_id": f"urn:row:{i}", "record_type": "response", "target_uri": None, "date": "d", "payload_digest": None,
                     "refers_to": None, "payload_length": None, "payload": rng.randbytes(rng.choice((0, 10, 5_000, 3_000_000)))}
    rows = [row(i) for i in range(25)]
    plain = b"".join(map(warc.record, rows))
    whole = [(r["record_id"], r["payload"]) for r in rows]
    pieces = b"".join(gzip.compress(plain[i:i + 1_000_003]) for i in range(0, len(plain), 1_000_003))
    members = b"".join(warc.member(warc.record(r)) for r in rows)
    found = lambda data, test=lambda f: True, payload=True: list(warc.records(io.BytesIO(data), test, payload))
    for data in (plain, gzip.compress(plain), pieces, members, members + gzip.compress(plain) + plain):
        got = [warc.row_of(f, b) for f, b in found(data)]
        assert [(r[0], r[7]) for r in got] == whole * (len(got) // 25) and len(got) == (75 if len(data) > 2 * len(plain) else 25)
        last = found(data, lambda f: f["warc-record-id"] == "<urn:row:24>", payload=False)
        assert len(last) == len(got) // 25
    tail = len(warc.record(rows[-1]))
    for data in (plain[:-tail + 30], plain[:-10], gzip.compress(plain)[:-20], members[:-20]):
        for test in (lambda f: True, lambda f: False):
            with pytest.raises((ValueError, warc.zlib.error)):
                found(data, test)


def test_lengths_without_payloads():
    """Headers alone tell the same lengths, however long the HTTP header; a payload in chunks or a digest in small letters is read."""
    body = random.Random(1).randbytes(50_000)
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()

    def archive(http, content, told=digest, kind="response"):
        block = http + content
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:row:1>\r\nWARC-Payload-Digest: sha1:{told}\r\n"
                f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    plain = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (body[:20_000], body[20_000:])) + b"0\r\n\r\n"
    for data, length in ((archive(plain, body), 50_000), (archive(plain, body, digest.lower()), 50_000),
                         (archive(b"HTTP/1.1 200 OK\r\nX: " + b"y" * 9_000 + b"\r\n\r\n", body), 50_000),
                         (archive(b"HTTP/1.1 200 OK\r\nContent-Length: 50000, 50000\r\n\r\n", body), 50_000),
                         (archive(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", chunked), len(chunked))):
        for form in (data, warc.member(data), gzip.compress(data)):
            found = [warc.row_of(f, b, payload)[6] for payload in (True, False) for f, b in warc.records(io.BytesIO(form), lambda f: True, payload)]
            assert found == [length, length]
    with pytest.raises(ValueError, match="digest"):
        f, b = next(warc.records(io.BytesIO(archive(plain, body[1:])), lambda f: True))
        warc.row_of(f, b)
    f, b = next(warc.records(io.BytesIO(archive(b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n", b"", kind="revisit")), lambda f: True, False))
    assert warc.row_of(f, b, False)[6] is None


def test_no_class_loses_its_text(spark):
    """A row that repeats an id with another text has a class of its own; every class keeps one row."""
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (1, b), (2, a)]
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.text for r in kept.collect()) == [a, b]
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts)) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [tuple(r) for r in partenum.keep_one(df, 2, 50, 100).collect()]
    sets = {t: {tuple(w[i:i + 2]) for i in range(len(w) - 1)} or {tuple(w)} for t in texts if (w := t.split())}
    root = {t: t for t in {t for _, t in rows}}
    for x in root:
        for y in root:
            if 2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y]):
                one, two = root[x], root[y]
                root = {t: one if r == two else r for t, r in root.items()}
    assert len(got) == len(set(root.values())) == len({root[t] for _, t in got})
    least = {}
    for key, text in rows:
        least[root[text]] = min(least.get(root[text], (True, 0)), (key is None, key or 0))
    assert all((key is None, key or 0) == least[root[text]] for key, text in got)


def similar(a, b, num, den):
    common = len(np.intersect1d(a, b))
    return den * common >= num * (len(a) + len(b) - common)


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    sets, labels = [], []
    for size in (1, 2, 5, 30, 60, 66, 125, 131, 300, 510, 515, 1020, 1030, 2040, 2100):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for share in (0, 0.02, 0.1, 0.11, 0.2, 0.3, 0.45):
            own = np.unique(np.concatenate([base[rng.random(size) >= share], rng.integers(0, 1 << 63, rng.integers(0, 2 + int(share * size))).astype(np.uint64)]))
            if len(own):
                sets.append(own)
                labels.append(rng.integers(0, 4) if size < 100 else len(sets))
    sizes, labels = np.array([len(s) for s in sets]), np.array(labels)
    for num, den in ((50, 100), (80, 100), (85, 100)):
        for sides in (None, rng.integers(0, 2, len(sets))):
            want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
                    if labels[i] != labels[j] and (sides is None or sides[i] != sides[j]) and similar(sets[i], sets[j], num, den)}
            i, j, _ = partenum.close_pairs(sizes, labels, [partenum.sketch(s) for s in sets], sides, num, den)
            got = [(min(p), max(p)) for p in zip(i.tolist(), j.tolist())]
            assert len(got) == len(set(got)) and want <= set(got) and len(got) <= 1.5 * len(want) + 20


@pytest.mark.parametrize("meet, near", [(4096, 32), (16, 32), (16, 1)])
def test_a_family_that_is_not_similar_moves_few_sets(spark, monkeypatch, meet, near):
    """Near copies that share signatures, few of them similar; sets that are moved for an exact check are counted."""
    from test_methods import plain_classes

    rng, texts = random.Random(11), {}
    base = [f"w{i}" for i in range(120)]
    for k in range(300):
        own = base[:]
        for at in rng.sample(range(120), 9 if k % 10 else 3):
            own[at] = f"x{rng.randrange(10 ** 6)}"
        texts[k] = " ".join(own)
    monkeypatch.setattr(partenum, "BLOCK", 16)
    for name, value in (("MEET", meet), ("NEAREST", near)):
        monkeypatch.setattr(partenum, name, value, raising=False)
    moved, cut = [], partenum.cut_and_free

    def counted(df):
        found = cut(df)
        if "task" in df.columns and "more" not in df.columns:
            moved.append(found.count())
        return found

    monkeypatch.setattr(partenum, "cut_and_free", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 2, 80, 100).collect()}
    assert got == plain_classes(texts, 2, 80, 100)
    # Once per pair of blocks, of 16 nodes each, it was 2 * 16 sets.
    assert sum(moved) < 2 * len(texts)


def random_family(size, words, edits, seed):
    rng, base = random.Random(seed), [f"w{i}" for i in range(words)]
    return {k: " ".join(f"x{rng.randrange(10 ** 6)}" if at in gone else w for at, w in enumerate(base))
            for k in range(size) if (gone := set(rng.sample(range(words), rng.randrange(1, edits + 1)))) is not None}


def test_links_grow_with_the_family(spark, monkeypatch):
    """Of a family whose classes are all similar to each other each task gives as many links as connect them, not one a pair."""
    from test_methods import plain_classes

    monkeypatch.setattr(partenum, "BLOCK", 2)
    given, found = [], partenum.components
    monkeypatch.setattr(partenum, "components", lambda links: (given.append(links.count()), found(links))[1])
    texts = random_family(240, 60, 2, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 2, 80, 100).collect()}
    assert got == plain_classes(texts, 2, 80, 100)
    assert max(given) < 5 * 240, given


def test_connecting_pairs(monkeypatch):
    """Kept pairs connect what all pairs connect, with or without intermediate reductions, and tell where others are left out."""
    rng = np.random.default_rng(8)
    for held in (1, 50, 1 << 19):
        monkeypatch.setattr(partenum, "HELD", held)
        for limit in (1, 3):
            labels = rng.integers(100, 160, 300) * 7
            pairs = rng.integers(0, 300, (2, 4000))
            group = lambda x: labels[x] // 7 % 3
            pairs = pairs[:, (labels[pairs[0]] != labels[pairs[1]]) & (group(pairs[0]) == group(pairs[1]))]
            pairs = np.vstack([pairs, rng.integers(0, 20, pairs.shape[1])])
            i, j, more = partenum.nearest(np.array_split(pairs, 9, axis=1), labels, limit)
            root = lambda i, j: partenum.spanning(range(300), [*zip(i, j), *((int(np.flatnonzero(labels == labels[k])[0]), k) for k in range(300))])
            assert sorted(root(i, j)) == sorted(root(pairs[0], pairs[1]))
            assert len(np.unique(labels)) - 3 <= len(i) <= 4 * limit * 60 and more.all()
    chain = np.array([[0, 1, 2, 4], [1, 2, 3, 5], [5, 5, 5, 5]])
    i, j, more = partenum.nearest([chain], np.arange(6), 1)
    assert sorted(zip(i, j)) == [(0, 1), (1, 2), (2, 3), (4, 5)] and not more.any()
    assert [len(x) for x in partenum.nearest([], np.arange(3), 1)] == [0, 0, 0]


@pytest.mark.parametrize("block", [3, 256])
def test_joining_is_exact(monkeypatch, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    rng = np.random.default_rng(2)
    sets = []
    for size in (1, 20, 60, 200):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(size) >= share], base[:1], rng.integers(0, 1 << 63, int(size * share / 2)).astype(np.uint64)]))
                 for share in (0, 0.01, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2)]
    labels = rng.integers(0, 30, len(sets))
    for sides in (np.zeros(len(sets), int), rng.integers(1, 3, len(sets))):
        want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (not sides[i] or sides[i] != sides[j]) and similar(sets[i], sets[j], 85, 100)]
        found = partenum.joining(sets, labels, sides, 85, 100)
        assert all(similar(sets[i], sets[j], 85, 100) and labels[i] != labels[j] for i, j in found) and len(found) < len(np.unique(labels))
        first = [(int(np.flatnonzero(labels == labels[k])[0]), k) for k in range(len(sets))]
        assert sorted(partenum.spanning(range(len(sets)), found + first)) == sorted(partenum.spanning(range(len(sets)), want + first))


def test_short_and_unspaced_items(spark):
    items = spark.createDataFrame([(1, "capital of france is"), (2, "北京是中华人民共和国的首都也是全国的政治中心"), (3, "กรุงเทพมหานครเป็นเมืองหลวง"), (4, ""), (5, None)], "item_id int, text string")
    rows = [(1, "The capital of France is Paris."), (2, "我们知道北京是中华人民共和国的首都也是全国的政治中心。"), (3, "เรารู้ว่ากรุงเทพมหานครเป็นเมืองหลวงของไทย"),
            (4, "the capital is of france"), (5, "北京很大"), (6, None)]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in rows], "doc_id string, text string")
    assert sorted((r.doc_id, r.item_id) for r in tiling.contaminated(df, items).collect()) == [("d1", 1), ("d2", 2), ("d3", 3)]
    assert sorted(r.doc_id for r in tiling.keep(df, items).collect()) == ["d4", "d5", "d6"]


def test_tiles_of_repeated_words():
    import time

    begun = time.time()
    assert tiling.greedy_tiles(np.ones(20_000, np.int64), np.ones(40, np.int64), 5) == [(0, 0, 40)]
    assert time.time() - begun < 3


def test_patterns_that_do_not_cut_at_blanks():
    """Texts are cut only where the pattern allows it; ids are those of the whole text either way."""
    import pyarrow as pa

    assert not pretokens.cuts_at_blanks(r"\S+ ?|\s+") and not pretokens.cuts_at_blanks(r"\w+ \w+|\S+|\s+") and pretokens.cuts_at_blanks(public_tokenizers.PATTERN)
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    texts = ["one two  three\n four", "a\u3000 b", None, "", " ", "a ", " x", "tab\t and", "漢字 🙂 ok", "don't 's"] + [f"word{i} more" for i in range(300)]
    for pattern in (public_tokenizers.PATTERN, r"\S+ ?|\s+"):
        chunks = pretokens.PieceChunks(pattern, bpe.Transducer(ranks), 20_000)   # a memo that is begun anew often
        for limit in (0, 10_000):
            encoder = pretokens.TextEncoder(pattern, chunks, chunks.text, "<u4", limit)
            import tiktoken
            plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for _ in range(2):
                assert [x.tolist() for x in encoder(pa.array(texts))] == [plain.encode_ordinary(t or "") for t in texts]
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, plain = tokenfile.LibraryEncoder(open(path).read(), public_tokenizers.PATTERN), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert [x.tolist() for x in library(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_that_begin_alike_are_read_together(monkeypatch):
    """New words cost the bytes in which they differ from the one before, not all that follows a move that is not made."""
    import pyarrow as pa

    read, bytes_read = bpe.Transducer.read, [0]

    def counted(self, *args):
        bytes_read[0] += len(args[-1])
        return read(self, *args)

    monkeypatch.setattr(bpe.Transducer, "read", counted)
    rng = random.Random(8)
    parts = ["ka", "ron", "del", "vis", "po", "ham", "è", "ü", "th"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(3, 7))) for _ in range(4000)})
    rng.shuffle(words)
    texts = [" ".join(words[at:at + 50]) for at in range(0, len(words), 50)]
    content = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = bpe.read_ranks(content)
    pieces = [[word if k == 0 else f" {word}" for k, word in enumerate(text.split(" "))] for text in texts]
    want = [[ranks[token] for piece in text for token in bpe.merge(piece.encode(), ranks)] for text in pieces]
    for memo_bytes in (bpe.MEMO_BYTES, 100 * bpe.STATE_BYTES):  # with little memory all is made anew often
        bytes_read[0] = 0
        assert [x.tolist() for x in bpe.text_encoder(content, public_tokenizers.PATTERN, memo_bytes)(pa.array(texts))] == want
        assert bytes_read[0] < 6 * len(words), (bytes_read[0], len(words))


def test_articles_of_other_templates(spark):
    """Tables, lists, headings and lines of an article stay; readers' comments and notices go, wherever they stand."""
    from colloquy.llm import domtree
    from colloquy.llm.common import table

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    model = domtree.fit(pages)
    long = "This is a sentence of the article, and it goes on for a while, so that it is long enough. "
    page = lambda body: f"<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav>{body}<footer>All rights reserved</footer></body></html>"
    art = lambda inner: page(f"<article><h1>Title here</h1><p>{long * 2}</p>{inner}<p>{long * 2}</p></article>")
    stay = ["<table><tr><th>cella</th><th>cellb</th></tr><tr><td>cellc</td><td>celld</td></tr></table>", "<ol><li>cella</li><li>cellb</li><li>cellc then celld</li></ol>",
            "<h3>cella cellb cellc celld</h3>", "<header><h2>cella cellb cellc celld</h2></header>", "<details><summary>cella cellb</summary><p>cellc celld</p></details>",
            "<p>cella cellb<br>cellc celld</p>", "<pre>cella cellb cellc celld</pre>", "<figure><img src=x><figcaption>cella cellb cellc celld</figcaption></figure>"]
    names = ['section id="comments"', 'div class="discussion"', 'div class="user-posts"', 'div class="responses"', 'ol class="commentlist"', 'div class="gdpr"']
    said = "<p>Some reader wrote zzgone here, and liked it.</p><p>Another one answered zzgone too.</p>"
    said_in = lambda n: f"<{n}>" + (said.replace("<p>", "<li>").replace("</p>", "</li>") if n.startswith("ol") else said) + f"</{n.split()[0]}>"
    lost = [s for s in stay if not all(w in model.text(art(s)) for w in ("cella", "cellb", "cellc", "celld"))]
    kept = [n for n in names for form in (page(f"<article><h1>Title here</h1><p>{long * 3}</p>{said_in(n)}</article>"),
                                          page(f"<article><h1>Title here</h1><p>{long * 3}</p></article>{said_in(n)}")) if "zzgone" in model.text(form) or "sentence" not in model.text(form)]
    assert (lost, kept) == ([], [])
    assert domtree.extract(pages.select("page_id", "html").limit(5), model).columns == ["page_id", "text"]
