"""Word-level text functions, all JVM-side column expressions."""

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
# Every character that separates words: Unicode white space and four ASCII
# separators. Written for Java patterns, where the flag widens \\s.
UNICODE = "(?U)"
SPACE = r"[\s\x1c\x1d\x1e\x1f]"
# ----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """The words of ``text``; an empty array for a blank text."""
    return F.filter(F.split(_col(text), UNICODE + SPACE + "+"), lambda w: w != "")


def n_words(text) -> Column:
    return F.size(words(text)).cast("bigint")


def strip(text) -> Column:
    return F.regexp_replace(_col(text), f"{UNICODE}^{SPACE}+|{SPACE}+$", "")


def is_blank(text) -> Column:
    return ~_col(text).rlike(f"{UNICODE}[^{SPACE[1:]}")


def drop_blank(df, text="text", trim=True):
    """Keep rows whose text holds a word; strip it unless ``trim`` is off."""
    kept = df.filter(~is_blank(text))
    return kept.withColumn(text, strip(text)) if trim else kept


def join_pieces(pieces) -> Column:
    """One transcript from the pieces recognised in a chunk."""
    return strip(F.array_join(_col(pieces), " "))


def tail_words(text, n: int) -> Column:
    """The last ``n`` words, single-spaced; a shorter text stays as it is."""
    w = words(text)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, F.size(w) - n + 1, n), " ")) \
        .otherwise(_col(text))


def mm_ss(seconds) -> Column:
    s = _col(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def m_s(seconds) -> Column:
    s = _col(seconds).cast("bigint")
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def session_id(start) -> Column:
    return F.date_format(_col(start), "yyyyMMdd_HHmmss")


def elapsed_seconds(start, end, wrap=False) -> Column:
    """Whole seconds between two times; ``wrap`` leaves whole days out."""
    exact = (_col(end) - _col(start)).cast("interval second").cast("decimal(20,6)")
    seconds = F.floor(exact).cast("bigint")
    return F.pmod(seconds, F.lit(86400)) if wrap else seconds


def elapsed_minutes(start, end, wrap=False) -> Column:
    return F.floor(elapsed_seconds(start, end, wrap) / 60)


def epoch_micros(df, ts: str) -> Column:
    """Microseconds since 1970 of a time column, with or without a zone."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        since = F.col(ts) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return F.unix_micros(F.col(ts))
