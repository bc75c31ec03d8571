"""Tables of the narration data model, read from Parquet, and the stand-ins that the driver's tables give for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1990-01-01"
#: How the stand-in transcript differs from its document (by pmod(31 doc_id + i, 97)), and its timing.
DROPPED, REPLACED, FOLLOWED, MODULUS, STEP, LENGTH = 0, 1, 2, 97, 0.4, 0.3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pickups(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as pickups: one passage to record again, of a chapter (order)."""
    start = F.datediff("l_shipdate", F.lit(EPOCH)).cast("double")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("chapter_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("word_id"),
        F.when(F.col("l_returnflag") == "R", "skip").when(F.col("l_returnflag") == "A", "insert").otherwise("sub").alias("kind"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("open").alias("status"),
        start.alias("t_start"),
        (start + F.col("l_quantity")).alias("t_end"),
        F.col("l_discount").alias("confidence"),
    )


def told_pickups(spark: SparkSession, folder: str) -> DataFrame:
    """Pickups with what is written and heard, an id, a seat and a note; each seventh line is a pause, some are ignored."""
    rows = pickups(spark, folder)
    pause = F.col("line") == 7
    text = lambda p, n: F.concat(F.lit(p), (F.col("word_id") % n).cast("string"))
    return rows.select(
        "chapter_id",
        "line",
        F.concat_ws(":", F.col("chapter_id").cast("string"), F.col("line").cast("string"), F.col("word_id").cast("string"), F.col("t_end").cast("int").cast("string")).alias("id"),
        F.when(pause, "pause").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("word_id") % 11 == 0, "ignored").otherwise(F.col("status")).alias("status"),
        "t_start",
        "t_end",
        F.when(pause, "Pause > 4s").when(F.col("kind") == "insert", "").otherwise(text("Word-", 50)).alias("expected"),
        F.when(pause | (F.col("kind") == "skip"), "").otherwise(text("said, ", 7)).alias("heard"),
        "confidence",
        F.when(F.col("line") % 2 == 0, "N1").otherwise("N2").alias("seat"),
        F.when(F.col("word_id") % 3 == 0, 'see "a|b",\n  twice').alias("note"),
    )


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as chapters of a book (customer)."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("book_id"),
        F.col("o_orderkey").alias("chapter_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("words"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderpriority").alias("title"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the cores, where their files have fewer splits than that; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Fixed value: parts for each split of a file, where rows are dealt by a key.
PARTS = 8


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table dealt by a key into parts whose number grows with its files, so that what a task sorts, joins or counts does not."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS * rows.rdd.getNumPartitions())
    return rows.repartition(parts, *keys)


#: The same rows in SQL, as common table expressions.
PICKUPS_SQL = f"""p AS (SELECT l_orderkey AS chapter_id, l_linenumber AS line, l_partkey AS word_id,
    CASE l_returnflag WHEN 'R' THEN 'skip' WHEN 'A' THEN 'insert' ELSE 'sub' END AS kind,
    CASE l_linestatus WHEN 'F' THEN 'done' ELSE 'open' END AS status,
    CAST(date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t_start,
    CAST(date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity AS t_end,
    l_discount AS confidence FROM lineitem)"""
TOLD_SQL = f"""{PICKUPS_SQL}, sp AS (SELECT chapter_id, line, concat_ws(':', chapter_id, line, word_id, CAST(t_end AS INT)) AS id, CASE WHEN line = 7 THEN 'pause' ELSE kind END AS kind,
    CASE WHEN word_id % 11 = 0 THEN 'ignored' ELSE status END AS status, t_start, t_end, CASE WHEN line = 7 THEN 'Pause > 4s' WHEN kind = 'insert' THEN '' ELSE 'Word-' || (word_id % 50) END AS expected,
    CASE WHEN line = 7 OR kind = 'skip' THEN '' ELSE 'said, ' || (word_id % 7) END AS heard, confidence, CASE WHEN line % 2 = 0 THEN 'N1' ELSE 'N2' END AS seat,
    CASE WHEN word_id % 3 = 0 THEN 'see "a|b",' || chr(10) || '  twice' END AS note FROM p)"""
CHAPTERS_SQL = """c AS (SELECT o_custkey AS book_id, o_orderkey AS chapter_id, o_orderstatus AS status, o_totalprice AS words,
    o_orderdate AS updated_at, o_orderpriority AS title FROM orders)"""
