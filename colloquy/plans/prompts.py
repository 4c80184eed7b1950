"""Wording and parameters of model requests."""

from pyspark.sql import DataFrame, SparkSession, types as T

from colloquy.fixed_values import MAX_TOKENS, TEMPERATURE

_ROLE = (
    "You advise engineers during a technical meeting. Report only what the transcript says or implies, "
    "do not repeat earlier findings, and name services and practices precisely. If the talk is not technical, "
    "just summarise it. Answer with one JSON object holding technical_analysis (a text) and potential_issues, "
    "recommendations, clarifying_questions, action_items (lists of texts)."
)
SYSTEM_PROMPTS = {
    "incremental": _ROLE,
    "comprehensive": _ROLE + " This review was asked for: cover the whole discussion in depth.",
    "final": _ROLE + " The meeting is over: cover all of it, with every decision and task.",
    "summary": "Summarise this part of a technical meeting in two or three sentences: decisions, systems, problems.",
}
_KIND = T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("system_prompt", T.StringType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("max_tokens", T.IntegerType()),
    T.StructField("json_mode", T.BooleanType()),
])


def request_kinds(spark: SparkSession) -> DataFrame:
    """Parameters per kind of request: four fixed rows."""
    rows = [(k, p, TEMPERATURE, MAX_TOKENS[k], k != "summary") for k, p in SYSTEM_PROMPTS.items()]
    return spark.createDataFrame(rows, _KIND)
