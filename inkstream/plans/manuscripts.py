"""Queries over manuscripts (the documents table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions.text import WORD, WORDS_PER_HOUR, minutes, words


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, narration minutes and manuscripts over two hours, per source and language."""
    n = F.size(words(F.col("text"))).cast("long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", n.alias("n"))
    return docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("manuscripts"),
        F.sum("n").alias("words"),
        F.round(minutes(F.sum("n")), 6).alias("minutes"),
        F.count_if(minutes(F.col("n")) > 120).alias("over_120"),
    )


TOKENS = f"len(regexp_extract_all(coalesce(text, ''), '{WORD.replace(chr(39), chr(39) * 2)}'))"

QUERIES = {"token_stats": token_stats}
ORACLES = {
    "token_stats": f"""
        SELECT source, lang, count(*) AS manuscripts, CAST(sum(n) AS BIGINT) AS words,
               round(sum(n) / {WORDS_PER_HOUR}.0 * 60, 6) AS minutes,
               CAST(count(*) FILTER (WHERE n / {WORDS_PER_HOUR}.0 * 60 > 120) AS BIGINT) AS over_120
        FROM (SELECT source, lang, {TOKENS} AS n FROM documents) GROUP BY source, lang"""
}
