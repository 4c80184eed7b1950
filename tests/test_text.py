from pyspark.sql import functions as F

from colloquy.functions import text as X


def test_words_are_those_of_python(spark):
    spaces = [chr(c) for c in range(1, 0xD800) if chr(c).isspace()]
    assert len(spaces) == 29
    texts = [f"a{s}b{s}{s}c" for s in spaces] + [f"{s}x{s}" for s in spaces] + spaces + ["", " ", "a", "a​b", "é ü\nß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", X.n_words("t").alias("n"), X.words("t").alias("w"), X.strip("t").alias("s"), X.is_blank("t").alias("b")).collect()
    for r in rows:
        assert (r.n, r.w, r.s, r.b) == (len(r.t.split()), r.t.split(), r.t.strip(), not r.t.strip()), repr(r.t)


def test_blank_rows_go(spark):
    df = spark.createDataFrame([(" a ",), (" ",), ("",), ("b",)], "text string")
    assert [r.text for r in X.drop_blank(df).collect()] == ["a", "b"]
    assert [r.text for r in X.drop_blank(df, trim=False).collect()] == [" a ", "b"]


def test_tail_words(spark):
    df = spark.createDataFrame([("a  b\nc",), ("a  b c d",)], "t string")
    assert [r[0] for r in df.select(X.tail_words("t", 3)).collect()] == ["a  b\nc", "b c d"]


def test_clocks(spark):
    df = spark.sql("select timestamp'2024-01-01 23:00:00' a, timestamp'2024-01-03 00:30:59.5' b")
    r = df.select(X.elapsed_minutes("a", "b").alias("m"), X.elapsed_minutes("a", "b", wrap=True).alias("w"),
                  X.session_id("a").alias("s"), X.mm_ss(F.lit(65)).alias("c"), X.m_s(F.lit(125)).alias("d")).first()
    assert (r.m, r.w, r.s, r.c, r.d) == (25 * 60 + 30, 90, "20240101_230000", "01:05", "2m 5s")


def test_pieces(spark):
    df = spark.createDataFrame([([" a ", "b", " "],)], "p array<string>")
    assert df.select(X.join_pieces("p")).first()[0] == "a  b"
