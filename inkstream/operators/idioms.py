"""Shapes that many operators share: runs, sessions, as-of joins and index percentiles. All spill; none collects a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """Number the runs of equal `value` within keys, in order, from 1. Null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turns = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_turn", turns.cast("long")).withColumn(out, F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def gap_sessions(df: DataFrame, keys: list[str], start: str, end: str, gap: float, out: str = "session", ties: tuple[str, ...] = ()) -> DataFrame:
    """Number the groups of intervals of which each starts at most `gap` after all before it have ended."""
    w = Window.partitionBy(*keys).orderBy(start, end, *ties)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col(start) > reach + gap)
    return df.withColumn("_opens", opens.cast("long")).withColumn(out, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def scan(df: DataFrame, keys: list[str], order: list[str], values: list[str], make: Callable[[], Scan], fields: str, settled: str | None = None, together: bool = False) -> DataFrame:
    """keys and the fields of the rows that a fold gives, each key's rows in order: for what depends on all rows before and is no sum.
    Rows stream through a task with the fold's own state; none is collected. `make` begins a key; its `feed` takes the values of a
    row and its `close` ends the key, both give rows. Rows for which the column `settled` is true have their fields already and pass
    by the fold as columns. `together` says that rows of a key are in one part, as they come from a window over the keys."""
    kinds = T._parse_datatype_string(fields).fields
    schema = T.StructType([*[df.schema[k] for k in keys], *kinds])
    asked = [*keys, *values, *order, *([settled, *(k.name for k in kinds)] if settled else [])]
    rows = df.select(*dict.fromkeys(asked))
    rows = (rows if together else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, types = None, None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=schema.names)

        for batch in batches:
            types = types or [*(batch.column(k).type for k in keys), *([batch.column(k.name).type for k in kinds] if settled else to_arrow_schema(T.StructType(kinds)).types)]
            if settled:
                done = batch.column(settled)
                if done.true_count:
                    past = batch.filter(done)
                    yield pa.RecordBatch.from_arrays([past.column(c) for c in schema.names], names=schema.names)
                batch = batch.filter(pc.invert(done))
            found: list[tuple] = []
            for of, row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*(batch.column(v).to_pylist() for v in values))):
                if fold is None or of != key:
                    found += [(*key, *r) for r in fold.close()] if fold is not None else []
                    key, fold = of, make()
                found += [(*of, *r) for r in fold.feed(*row)]
            if found:
                yield out(found)
        if fold is not None and (found := [(*key, *r) for r in fold.close()]):
            yield out(found)

    return rows.mapInArrow(run, schema)


def lists(column: pa.Array) -> Iterator[list]:
    """The lists of an Arrow column one after the other, so that no batch is held as Python objects as a whole; a null is empty, and
    a number that is null among numbers is not a number."""
    offsets = column.offsets.to_numpy()
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield column.values.slice(low, high - low).to_numpy(zero_copy_only=False).tolist()


class Scan:
    """A fold over the rows of one key."""

    def feed(self, *row) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return []


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last row of right at or before each row's `at` (null where there is none).

    A sorted union instead of a range join: rows of right stand before rows of left of equal `at`."""
    side = lambda df, rank, own: df.withColumn("_side", F.lit(rank)).withColumn("_row", F.struct(*own) if rank == 0 else F.lit(None))
    seen = [c for c in left.columns if c not in keys + [at]]
    both = side(right.select(*keys, at, *values), 0, values).drop(*values).unionByName(left.withColumns({"_side": F.lit(1)}), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*keys, at, *seen, *[F.col(f"_last.{v}").alias(v) for v in values])


def index_percentile(df: DataFrame, keys: list[str], value: str, p: float, last: bool = False, out: str = "percentile") -> DataFrame:
    """keys, out: the value at index floor(n p), or floor((n - 1) p) if `last`, of the ordered values of each group."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    index = F.least(F.floor((n - 1 if last else n) * p), n - 1)
    ranked = df.select(*keys, value).withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_at": index})
    return ranked.where("_i = _at").select(*keys, F.col(value).alias(out))


def nearest(pairs: DataFrame, keys: list[str], distance: Column, ties: list[Column]) -> DataFrame:
    """Of the pairs of each key, the one at the least distance."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(distance, *ties))).where("_n = 1").drop("_n")
