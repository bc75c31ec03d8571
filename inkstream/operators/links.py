"""Names of a glossary in a script: spans of text are parted where a name stands, and carry its id.

Every stretch of a span that has as many words as some name meets the names by a join on all its letters, so a word that begins
many names is not compared with each of them, and no row carries its span. Of names that overlap, the leftmost has the place, and
of those that begin together the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RUN = r"[\p{L}\p{N}]+"
PARTS = rf"([^\p{{L}}\p{{N}}]*)({RUN})?"
#: From the first letter of a name to its last.
CORE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
#: Fixed value: stretches that leave a worker together.
STRETCHES_AT_ONCE = 50_000


def entries(glossary: DataFrame) -> DataFrame:
    """id, spelling, word (lower case), first (its first run of letters), lead (signs before that): one row a spelling, that of a
    person before one that was found, then the least id. glossary: id, spelling, source. Spellings without letters are left out."""
    spelling = F.trim("spelling")
    word = F.lower(spelling)
    order = Window.partitionBy("word").orderBy(F.col("source") != "user", "id")
    rows = glossary.select("id", spelling.alias("spelling"), word.alias("word"), "source").where(F.col("word").rlike(RUN))
    one = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return one.select("id", "spelling", "word", F.regexp_extract("word", RUN, 0).alias("first"), F.length(F.regexp_extract("word", PARTS, 1)).alias("lead"))


def _stretches(spans: DataFrame, keys: list[str], text: str, sizes: str) -> DataFrame:
    """keys, start, core, before, after of each stretch of a text that has one of these numbers of words: its letters, and what stands
    beside it up to one letter of the words before and after."""
    schema = T.StructType([*[spans.schema[k] for k in keys], *T._parse_datatype_string("start int, core string, before string, after string").fields])
    word = regex.compile(RUN)

    def of(text: str, sizes: list[int]) -> Iterator[tuple[int, str, str, str]]:
        runs = [m.span() for m in word.finditer(text)]
        befores = [text[a:z] for a, z in zip([0, *(z - 1 for _, z in runs)], [a for a, _ in runs])]
        afters = [text[a:z] for a, z in zip([z for _, z in runs], [*(a + 1 for a, _ in runs[1:]), len(text)])]
        for n in sizes:
            for i in range(len(runs) - n + 1):
                a, z = runs[i][0], runs[i + n - 1][1]
                yield a, text[a:z], befores[i], afters[i + n - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)

        def out(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
            rest = batch.select(keys).take(pa.array(at, pa.int32()))
            return pa.RecordBatch.from_arrays([*rest.columns, *[pa.array(c, k) for c, k in zip(zip(*found), kinds.types[len(keys) :])]], schema=kinds)

        for batch in batches:
            at, found = [], []
            for i, (t, n) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1))):
                found += of(t.as_py(), n.as_py())
                at += [i] * (len(found) - len(at))
                if len(found) >= STRETCHES_AT_ONCE:
                    yield out(batch, at, found)
                    at, found = [], []
            if found:
                yield out(batch, at, found)

    return spans.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), sizes).mapInArrow(run, schema)


def matches(spans: DataFrame, glossary: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, start, end (exclusive), id of every place where a whole name stands, whatever its case; names may overlap."""
    rows = entries(glossary).select("id", "word", F.regexp_extract("word", CORE, 0).alias("core"), F.substring("word", F.lit(1), F.col("lead")).alias("_lead"))
    names = rows.select("id", "core", "_lead", F.substring("word", F.length("_lead") + F.length("core") + 1, F.length("word")).alias("_tail"))
    sizes = names.agg(F.sort_array(F.collect_set(F.regexp_count("core", F.lit(RUN)))).alias("_sizes"))
    met = _stretches(spans.crossJoin(sizes), keys, text, "_sizes").join(names, "core")
    letter = lambda side, i: F.substring(side, i, F.lit(1)).rlike(RUN)
    lead, tail, before, after = F.col("_lead"), F.col("_tail"), F.col("before"), F.col("after")
    opens = (lead == "") | F.endswith(before, lead) & ((F.length(before) == F.length(lead)) | ~letter(before, F.length(before) - F.length(lead)))
    closes = (tail == "") | F.startswith(after, tail) & ~letter(after, F.length(tail) + 1)
    start = F.col("start") - F.length("_lead")
    return met.where(opens & closes).select(*keys, start.alias("start"), (start + F.length("_lead") + F.length("core") + F.length("_tail")).alias("end"), "id")


def linked(spans: DataFrame, glossary: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns of spans with the text parted, and piece (from 0), start and glossary_id (null between names). A span without a
    name is one piece; no character is lost. keys name a span."""
    one = F.struct("start", (-F.col("end")).alias("less"), "end", "id")
    found = matches(spans, glossary, keys, text).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_found"))
    none = F.array().cast("array<struct<start int, end int, id string>>")
    picked = F.aggregate(
        "_found", F.struct(F.lit(0).alias("end"), none.alias("kept")),
        lambda s, m: F.when(m["start"] >= s["end"], F.struct(m["end"].alias("end"), F.concat(s["kept"], F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["id"].cast("string").alias("id")))).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    rows = spans.join(found.select(*keys, picked.alias("_kept")), keys, "left").withColumn("_kept", F.coalesce("_kept", none))
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    names = F.transform("_kept", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["id"].alias("id")))
    gap = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.lit(None).cast("string").alias("id"))
    ends = F.concat(F.array(F.lit(0)), F.transform("_kept", lambda m: m["end"]))
    starts = F.concat(F.transform("_kept", lambda m: m["start"]), F.array(n))
    between = F.filter(F.zip_with(ends, starts, gap), lambda g: g["end"] > g["start"])
    pieces = F.array_sort(F.concat(names, between))
    pieces = F.when(F.size(pieces) == 0, F.array(gap(F.lit(0), F.lit(0)))).otherwise(pieces)
    each = rows.select(*spans.columns, F.posexplode(pieces).alias("piece", "_p"))
    cut = F.substring(F.coalesce(F.col(text), F.lit("")), F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start"))
    return each.withColumn("start", F.col("_p.start")).withColumn("glossary_id", F.col("_p.id")).withColumn(text, cut).drop("_p")


def sliced(spans: DataFrame, keys: list[str], order: str, ranges: DataFrame, like: list[str], text: str = "text") -> DataFrame:
    """The styled spans of each range of a document: keys, range, at (from 0), the columns `like` and the text. Spans of a document lie
    end to end by `order`; neighbours that are alike in the columns `like` become one. ranges: keys, range, start, end."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_low", F.coalesce(F.sum(F.length(text)).over(so_far), F.lit(0))).withColumn("_high", F.col("_low") + F.length(text))
    wanted = ranges.where("end > start").select(*keys, "range", F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = placed.join(wanted, keys).withColumns({"_a": F.greatest("_low", "_start"), "_z": F.least("_high", "_end")}).where("_z > _a")
    part = met.withColumn(text, F.substring(F.col(text), (F.col("_a") - F.col("_low") + 1).cast("int"), (F.col("_z") - F.col("_a")).cast("int")))
    w = Window.partitionBy(*keys, "range").orderBy("_a")
    new = F.lag("_a").over(w).isNull()
    for c in like:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = part.withColumn("_new", new.cast("int")).withColumn("at", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", text))), lambda x: x[text]), "")
    return runs.groupBy(*keys, "range", "at", *like).agg(joined.alias(text))
