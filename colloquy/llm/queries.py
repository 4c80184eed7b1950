"""The operators as queries over the given tables, with SQL where it gives the same result."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import bpe, domtree, exact, langid, middle, partenum, sharding, shallot, syncmers, tiling, tokenfile, toxicity, warc
from colloquy.llm.common import crc_mod, scratch, small_batches, table

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return run
    return register


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; every fourth fold is held out of the labels."""
    documents, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)""")
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives: what its record says after they are read back."""
    folder = scratch(spark, "warc")
    warc.register(spark)
    warc.archive(table(spark, sf_dir, "pages"), folder)
    return spark.read.format("warc").load(folder).filter(F.col("record_type").isin("response", "revisit")).select(
        F.expr("try_cast(regexp_extract(record_id, '^urn:row:(-?[0-9]+)$', 1) as bigint)").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '^urn:row:(-?[0-9]+)$', 1) as bigint)").alias("refers_to"))


SHARD_BYTES = 1 << 20


@query(f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT k, h >> CAST(60 - k AS INT) AS pre, sum(b) AS total FROM d, range(0, 57) r(k) GROUP BY ALL),
l AS (SELECT doc_id, h, min(k) AS depth FROM d JOIN s ON pre = h >> CAST(60 - k AS INT) AND (total <= {SHARD_BYTES} OR k = 56) GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> CAST(60 - depth AS INT)), CAST(depth AS INT), '0') END AS shard,
       CAST(depth AS INT) AS depth, CAST(total AS BIGINT) AS shard_bytes
FROM l JOIN s ON k = depth AND pre = h >> CAST(60 - depth AS INT)""")
def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, none over a mebibyte of text."""
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "shard", "depth", "shard_bytes")


@query()
def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.edited(table(spark, sf_dir, "documents"))


@query()
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return partenum.classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; every third fold is held out of the labels."""
    documents, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) == 1
    model = langid.fit(documents.filter(~held_out))
    return langid.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through token files, with the offset of each document."""
    folder = scratch(spark, "tokens")
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), folder, content(vocabulary("byte_bpe_50k.json")).decode(),
                               split_pattern(), end=0)
    return tokenfile.read(spark, folder, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the transducer, and the bytes they decode to."""
    ranks = content(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, split_pattern(), decoded=True, memo_bytes=128 << 20).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words or more, with the items."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return domtree.extract(pages, domtree.fit(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query(r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, row_number() OVER w AS rank, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS size
      FROM d WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, size AS group_size, rank = 1 AS kept, sha256(t) AS text_sha256 FROM r""")
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and whether it stays."""
    return exact.classes(table(spark, sf_dir, "documents"), hash_all=True)


def _kmeans_sql(k=8, rounds=10) -> str:
    """The rounds of k-means one after the other."""
    steps = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM
      (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM
      (SELECT r, j, list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS v FROM (SELECT j, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM
      (SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept JOIN a{i} USING (r)) GROUP BY j, i)) GROUP BY j),
  c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (j))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c USING (j)"""


@query(_kmeans_sql())
def op12_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every usable embedding after ten rounds of exact k-means with eight centroids."""
    return shallot.cluster(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, CAST(8 * i + 1 AS INT), 8))::BIGINT) AS h FROM d),
y AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM z""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, and the text rebuilt from it."""
    return middle.transform(table(spark, sf_dir, "documents"))
