"""Report output."""

from pyspark.sql import DataFrame, functions as F

from colloquy.functions.responses import findings, report_lines
from colloquy.operators.history import transcript


def report(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Numbered findings and the transcript of each meeting as ordered lines."""
    numbered = report_lines(findings(results, by=("meeting_id",)))
    lines = numbered.select("meeting_id", F.col("kind").alias("section"), F.coalesce("ord", F.lit(0)).cast("bigint").alias("line_no"), "line")
    overview = results.select("meeting_id", F.lit("technical_analysis").alias("section"), F.lit(0).cast("bigint").alias("line_no"),
                              F.col("result.technical_analysis").alias("line"))
    parts = transcript(segments).select("meeting_id", F.lit("transcript").alias("section"), F.col("part").alias("line_no"), F.col("text").alias("line"))
    return overview.unionByName(lines).unionByName(parts)


def write_report(lines: DataFrame, path: str, fmt="parquet") -> None:
    lines.write.mode("overwrite").partitionBy("section").format(fmt).save(path)
