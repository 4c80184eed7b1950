"""From model responses (JSON text) to the fixed analysis schema."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.fixed_values import (
    BAD_JSON, EMPTY_SECTION_TEXT, ERROR_PREFIX, FINAL_DEFAULT_TEXT, HISTORY_FIELDS, LEGACY_DEFAULT_TEXT,
    LIST_FIELDS, LIVE_DEFAULT_TEXT, TEXT_FIELD,
)

_TEXTS = "array<string>"


def error_result(message) -> Column:
    """The analysis shown in place of one that failed."""
    message = F.lit(message) if isinstance(message, str) else message
    empty = F.array().cast(_TEXTS)
    return F.struct(F.concat(F.lit(ERROR_PREFIX), message).alias(TEXT_FIELD), *[empty.alias(f) for f in LIST_FIELDS])


def _problem(kind: Column, texts: Column, field: str, live: Column) -> Column:
    """Why a list field cannot be used; null if it can."""
    not_a_list = kind.isNotNull() & (kind != "VOID") & ~kind.startswith("ARRAY")
    # The live path compares history items with earlier ones, so they have to be texts.
    not_texts = (kind == "VOID") | (kind.startswith("ARRAY") & (
        ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(texts, lambda t: t.isNull())))
    bad = not_a_list | (live & not_texts if field in HISTORY_FIELDS else F.lit(False))
    return F.when(bad, F.lit(f"{field} is not a list of texts"))


def parse_responses(df: DataFrame, response="response", live=None, failure=None) -> DataFrame:
    """Add ``result`` (analysis struct), ``is_error`` and ``error``.

    ``live`` (column, default true) picks the rules of running analyses over
    those of the final one; ``failure`` names a column with the error of a call
    that gave no response. Absent keys get defaults, present nulls stay null.
    """
    live = F.lit(True) if live is None else live
    failed = F.col(failure) if failure else F.lit(None).cast("string")
    # Wrapped in a list, so that anything after the value makes it invalid.
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(response), F.lit("]")))
    out = df.withColumn("_v", listed)
    one = F.col("_v").isNotNull() & F.try_variant_get("_v", "$[1]", "variant").isNull()
    out = out.withColumn("_v", F.when(one, F.try_variant_get("_v", "$[0]", "variant")))
    names = (TEXT_FIELD, *LIST_FIELDS)
    for i, name in enumerate(names):
        raw = F.try_variant_get("_v", f"$.{name}", "variant")
        kind = "string" if name == TEXT_FIELD else _TEXTS
        out = out.withColumn(f"_k{i}", F.schema_of_variant(raw)).withColumn(
            f"_f{i}", F.try_variant_get("_v", f"$.{name}", kind))
    problems = [_problem(F.col(f"_k{i}"), F.col(f"_f{i}"), n, live) for i, n in enumerate(names) if n in LIST_FIELDS]
    error = F.coalesce(
        failed,
        F.when(F.col("_v").isNull(), F.lit(BAD_JSON)),
        F.when(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("response is not an object")),
        *problems)
    default = F.when(live, F.lit(LIVE_DEFAULT_TEXT)).otherwise(F.lit(FINAL_DEFAULT_TEXT))
    fields = [
        F.when(F.col(f"_k{i}").isNull(), default if n == TEXT_FIELD else F.array().cast(_TEXTS))
        .otherwise(F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)]
    out = out.withColumn("error", error).withColumn("is_error", F.col("error").isNotNull())
    out = out.withColumn("result", F.when(F.col("is_error"), error_result(F.col("error"))).otherwise(F.struct(*fields)))
    return out.drop("_v", *[f"_{p}{i}" for p in "kf" for i in range(len(names))])


def findings(results: DataFrame, by=("meeting_id", "fire_no")) -> DataFrame:
    """Numbered items of every list field; one row with null text for an empty list."""
    lists = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f"result.{f}").alias("items")) for f in LIST_FIELDS])
    rows = results.select(*by, F.explode(lists).alias("_l"))
    rows = rows.select(*by, F.col("_l.kind").alias("kind"), F.posexplode_outer("_l.items").alias("_o", "text"))
    return rows.select(*by, "kind", (F.col("_o") + 1).cast("int").alias("ord"), "text")


def report_lines(numbered: DataFrame) -> DataFrame:
    """Findings as display lines; an empty section says so."""
    empty = reduce(lambda w, kv: w.when(F.col("kind") == kv[0], kv[1]), EMPTY_SECTION_TEXT.items(), F)
    return numbered.withColumn(
        "line", F.when(F.col("ord").isNull(), empty).otherwise(F.format_string("%d. %s", "ord", "text")))


def findings_per_kind(results: DataFrame, by=("meeting_id", "fire_no")) -> DataFrame:
    lists = F.array(*[F.struct(F.lit(f).alias("kind"), F.size(F.coalesce(f"result.{f}", F.array().cast(_TEXTS))).alias("n"))
                      for f in LIST_FIELDS])
    return results.select(*by, F.inline(lists))


def legacy_view(df: DataFrame, response="response", by=("meeting_id",), defaults=None) -> DataFrame:
    """The four columns older front ends read, each with its own default."""
    defaults = {**LEGACY_DEFAULT_TEXT, **(defaults or {})}
    v = F.try_parse_json(response)

    def shown(name):
        if name == "summary":
            return F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(defaults[name])).alias(name)
        items = F.try_variant_get(v, f"$.{name}", _TEXTS)
        return F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(F.lit(defaults[name])).alias(name)

    return df.select(*by, *[shown(n) for n in LEGACY_DEFAULT_TEXT])


def latest(results: DataFrame, keep_errors=False) -> DataFrame:
    """Latest analysis per meeting; a failed one replaces it only on request."""
    rows = results if keep_errors else results.filter(~F.col("is_error"))
    return rows.groupBy("meeting_id").agg(
        F.max_by("result", "fire_no").alias("result"), F.max("fire_no").alias("fire_no"))


def shown_result(current: DataFrame, final: DataFrame) -> DataFrame:
    """The final analysis where there is one, else the latest."""
    f = final.select("meeting_id", F.col("result").alias("_final"))
    joined = current.select("meeting_id", "result").join(f, "meeting_id", "full_outer")
    return joined.select("meeting_id", F.coalesce("_final", "result").alias("result"),
                         F.col("_final").isNotNull().alias("is_final"))
